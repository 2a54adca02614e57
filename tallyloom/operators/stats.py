"""Reliability, effect sizes and regressions, from sums that are combined on the map side wherever they have a closed form."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Seed of the shuffles, and the bound under which a group counts as reliable.
SEED, RELIABLE = 25, 0.1


def _halves(x: list[float], rng: random.Random) -> tuple[list[float], list[float]]:
    s = rng.sample(x, len(x))
    return s[: len(s) // 2], s[len(s) // 2 :]


def split_half_d(x: Sequence[float], least: int = 3, n_perms: int = 1) -> tuple[float, float]:
    """Cohen's d between random halves: mean over the shuffles and its standard error; NaN below ``least`` values or without spread."""
    x = [float(v) for v in x]
    sd = float(np.std(x)) if x else 0.0
    if len(x) < max(least, 2) or sd == 0:
        return math.nan, math.nan
    rng = random.Random(SEED)
    d = [abs(np.mean(a) - np.mean(b)) / sd for a, b in (_halves(x, rng) for _ in range(n_perms))]
    return float(np.mean(d)), float(np.std(d) / math.sqrt(len(d)))


def split_half_h(x: Sequence[float], least: int = 3, n_perms: int = 1) -> tuple[float, float]:
    """The same for shares: |2 (asin sqrt p1 − asin sqrt p2)|; NaN also for means outside 0 and 1."""
    x = [float(v) for v in x]
    if len(x) < max(least, 2) or (n_perms > 1 and float(np.std(x)) == 0):
        return math.nan, math.nan
    rng = random.Random(SEED)
    h = []
    for _ in range(n_perms):
        p = [sum(part) / len(part) for part in _halves(x, rng)]
        if not all(0 <= v <= 1 for v in p):
            return math.nan, math.nan
        h.append(abs(2 * (math.asin(math.sqrt(p[0])) - math.asin(math.sqrt(p[1])))))
    return float(np.mean(h)), float(np.std(h) / math.sqrt(len(h)))


def reliability(df: DataFrame, group: str, value: str, measure: str = "d", n_perms: int = 30, least: int = 3) -> DataFrame:
    """Split-half effect sizes per group: group, n, effect, effect_se, reliable (effect + 1.96 se below 0.1).

    Values are sorted before they are shuffled with a fixed seed, so results don't
    depend on the order of rows; null and NaN values are left out. The shuffle needs a group's values
    in one task: for groups that may be large take ``reliability_hashed``, as all registered queries do.
    """
    how = {"d": split_half_d, "h": split_half_h}[measure]
    kind = dict(df.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["v"].to_numpy(dtype=float))
        effect, se = how(list(x), least, n_perms)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(x)], "effect": [effect], "effect_se": [se]})

    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    out = rows.groupBy("g").applyInPandas(run, f"g {kind}, n long, effect double, effect_se double")
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    out = out.withColumns({"effect": nan("effect"), "effect_se": nan("effect_se")})
    return out.withColumn("reliable", F.coalesce(F.col("effect") + 1.96 * F.col("effect_se") < RELIABLE, F.lit(False))).withColumnRenamed("g", group)


def reliability_hashed(df: DataFrame, group: str, value: str, id_: str, measure: str = "d", n_perms: int = 30, thresholds: Sequence[int] = (3,)) -> DataFrame:
    """Split-half effect sizes like ``reliability`` for groups of any size: the p-th half is told by the p-th hexadecimal digit of the md5 of the row's id.

    group, threshold, n, effect, effect_se, reliable; one row a group and threshold. Everything is sums that are combined
    on the map side; no group is held anywhere. A split with an empty half is left out. Effects
    are null below ``threshold`` values, without spread (``d``, and ``h`` of several splits), and for ``h`` where a half's mean is outside 0 and 1.
    """
    if not 0 < n_perms <= 32:
        raise ValueError("1 to 32 splits")
    v = F.col(value).cast("double")
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(v)).select(F.col(group).alias("g"), v.alias("v"), F.md5(F.col(id_).cast("string")).alias("i"))
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_pop("v").alias("sd"), F.sum("v").alias("s")]
    for p in range(n_perms):
        first = F.substring("i", p + 1, 1) < "8"
        aggs += [F.count_if(first).alias(f"n{p}"), F.sum(F.when(first, F.col("v"))).alias(f"s{p}")]
    s = rows.groupBy("g").agg(*aggs)
    some = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    halves = [(F.col(f"s{p}") / some(F.col(f"n{p}")), (F.col("s") - F.col(f"s{p}")) / some(F.col("n") - F.col(f"n{p}"))) for p in range(n_perms)]
    if measure == "d":
        each, ok = [F.abs(a - b) / some(F.col("sd")) for a, b in halves], F.col("sd") > 0
    elif measure == "h":
        angle = lambda x: F.asin(F.sqrt(F.when((x >= 0) & (x <= 1), x)))
        each, ok = [F.abs(2 * (angle(a) - angle(b))) for a, b in halves], (F.col("sd") > 0) | F.lit(n_perms == 1)
    else:
        raise ValueError(f"no measure {measure}")
    kept = s.select("g", "n", F.when(ok, F.filter(F.array(*each), lambda x: x.isNotNull())).alias("d"))
    kept = kept.withColumn("threshold", F.explode(F.array(*[F.lit(int(t)) for t in thresholds]))).withColumn("d", F.when(F.col("n") >= F.greatest("threshold", F.lit(2)), F.col("d")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    size = some(F.size("d"))
    out = kept.withColumn("effect", total("d") / size).withColumn("effect_se", F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("effect"), 2)) / size) / F.sqrt(size))
    return out.select(F.col("g").alias(group), "threshold", "n", "effect", "effect_se", effect(F.col("effect"), F.col("effect_se")).alias("reliable"))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return f


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if not (f == f and d1 > 0 and d2 > 0):
        return math.nan
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if not (t == t and df > 0):
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*map(float, v)) for v in zip(f.fillna(math.nan), d1.fillna(0), d2.fillna(0))])


@pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(*map(float, v)) for v in zip(t.fillna(math.nan), df.fillna(0))])


def icc(df: DataFrame, value: str, entity: str, thresholds: Sequence[int] = (0,)) -> DataFrame:
    """Intraclass correlations for each least number of values per entity.

    threshold, n_groups, n_obs, avg_n, ms_between, ms_within, f, p_value,
    icc1_ref (denominator with n_groups − 1), icc1 (with the usual mean group
    size n0), icc2_mean and icc2_std over entities (from icc1_ref). All from
    one aggregate per entity; thresholds unfold these few rows. Fewer than two groups: f and the correlations are null.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(entity).isNotNull())
    per = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    each = per.withColumn("threshold", F.explode(F.array(*[F.lit(int(t)) for t in thresholds]))).where(F.col("n") >= F.col("threshold"))
    sums = each.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_obs"), F.sum("ss").alias("ssw"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("n")).alias("nn")
    )
    between = each.join(F.broadcast(sums.select("threshold", "mean")), "threshold").groupBy("threshold").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"))
    some = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    t = sums.join(between, "threshold").withColumns({"avg_n": F.col("n_obs") / F.col("n_groups"), "d1": F.col("n_groups") - 1, "d2": F.col("n_obs") - F.col("n_groups")})
    t = t.withColumns({"ms_between": F.col("ssb") / some(F.col("d1")), "ms_within": F.col("ssw") / some(F.col("d2"))})
    t = t.withColumn("f", F.col("ms_between") / some(F.col("ms_within")))
    n0 = (F.col("n_obs") - F.col("nn") / F.col("n_obs")) / some(F.col("d1"))
    form = lambda k: (F.col("ms_between") - F.col("ms_within")) / some(F.col("ms_between") + (k - 1) * F.col("ms_within"))
    t = t.withColumns({"icc1_ref": form(F.col("n_groups")), "icc1": form(n0), "p_value": F.nanvl(f_p_value("f", F.col("d1").cast("double"), F.col("d2").cast("double")), F.lit(None).cast("double"))})
    each = each.join(F.broadcast(t.select("threshold", "icc1_ref")), "threshold")
    two = F.col("n") * F.col("icc1_ref") / some(1 + (F.col("n") - 1) * F.col("icc1_ref"))
    second = each.groupBy("threshold").agg(F.avg(two).alias("icc2_mean"), F.stddev_pop(two).alias("icc2_std"))
    return t.join(second, "threshold").select("threshold", "n_groups", "n_obs", "avg_n", "ms_between", "ms_within", "f", "p_value", "icc1_ref", "icc1", "icc2_mean", "icc2_std")


def simple_ols(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """Regression of y on x (per key): n, slope, intercept, r2, slope_se, intercept_se, slope_t (and slope_p). Null where x doesn't vary or n < 3. Rows with a null are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), (F.var_pop(a) * F.count(F.lit(1))).alias("sxx"), (F.var_pop(b) * F.count(F.lit(1))).alias("syy"), (F.covar_pop(a, b) * F.count(F.lit(1))).alias("sxy"))
    sxx, syy = F.nullif(F.col("sxx"), F.lit(0.0)), F.nullif(F.col("syy"), F.lit(0.0))
    s = s.withColumn("slope", F.col("sxy") / sxx).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("r2", F.col("sxy") * F.col("sxy") / sxx / syy)
    mse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.nullif(F.greatest(F.col("n") - 2, F.lit(0)).cast("double"), F.lit(0.0))
    s = s.withColumns({"slope_se": F.sqrt(mse / sxx), "intercept_se": F.sqrt(mse * (1 / F.col("n") + F.col("mx") * F.col("mx") / sxx))})
    s = s.withColumn("slope_t", F.col("slope") / F.nullif(F.col("slope_se"), F.lit(0.0)))
    out = [*keys, "n", "slope", "intercept", "r2", "slope_se", "intercept_se", "slope_t"]
    if p_values:
        s = s.withColumn("slope_p", F.nanvl(t_p_value("slope_t", (F.col("n") - 2).cast("double")), F.lit(None).cast("double")))
        out.append("slope_p")
    return s.select(*out)


def random_intercept(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Mixed model y = b0 + b1 x + u_group + e by REML: n, n_groups, intercept, slope, slope_se, var_group, var_residual.

    Only seven sums per group are gathered into one row, so groups must be few (regions or divisions, not users),
    and the variance ratio is found by a search over its profile likelihood; the rows stay where they are.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    per = rows.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"), F.sum(b * b).alias("yy"))
    packed = per.agg(F.collect_list(F.struct("n", "x", "y", "xx", "xy", "yy")).alias("g"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([reml(np.array([[r[k] for k in ("n", "x", "y", "xx", "xy", "yy")] for r in g], float)) for g in batch["g"]], columns=["n", "n_groups", "intercept", "slope", "slope_se", "var_group", "var_residual"])

    return packed.where(F.size("g") > 1).mapInPandas(run, "n long, n_groups long, intercept double, slope double, slope_se double, var_group double, var_residual double")


def reml(g: np.ndarray) -> tuple[int, int, float, float, float, float, float]:
    """REML estimates from per-group sums n, x, y, xx, xy, yy."""
    n, sx, sy, sxx, sxy, syy = g.T
    total = n.sum()

    def at(ratio: float):
        k = ratio / (1 + ratio * n)  # V_i^-1 = I - k J, in units of the residual variance
        a = np.array([[np.sum(n - k * n * n), np.sum(sx - k * n * sx)], [0.0, np.sum(sxx - k * sx * sx)]])
        a[1, 0] = a[0, 1]
        c = np.array([np.sum(sy - k * n * sy), np.sum(sxy - k * sx * sy)])
        beta = np.linalg.solve(a, c)
        rss = np.sum(syy - k * sy * sy) - beta @ c
        s2 = max(rss, 1e-300) / (total - 2)
        value = (total - 2) * math.log(s2) + np.sum(np.log1p(ratio * n)) + np.linalg.slogdet(a)[1]
        return value, beta, s2, a

    grid = np.concatenate([[0.0], np.logspace(-8, 6, 141)])
    try:
        best = int(np.argmin([at(r)[0] for r in grid]))
    except np.linalg.LinAlgError:
        return int(total), len(n), math.nan, math.nan, math.nan, math.nan, math.nan
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(80):
        third = (high - low) / 3
        if at(low + third)[0] <= at(high - third)[0]:
            high -= third
        else:
            low += third
    ratio = min(((low + high) / 2, 0.0), key=lambda r: at(r)[0])
    _, beta, s2, a = at(ratio)
    return int(total), len(n), float(beta[0]), float(beta[1]), float(math.sqrt(s2 * np.linalg.inv(a)[1, 1])), float(ratio * s2), float(s2)


def effect(value: Column, se: Column) -> Column:
    """Reliability mask of an effect and its standard error."""
    return F.coalesce(value + 1.96 * se < RELIABLE, F.lit(False))
