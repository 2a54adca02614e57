"""Transforms of feature tables (group_id, feat, value, group_norm)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions import numeric as N
from tallyloom.functions import text as X
from tallyloom.functions.cleaning import clean_group_id, clean_number, clean_text_value
from tallyloom.operators.ngrams import with_group_norm
from tallyloom.operators.selection import interpolated_percentiles, value_counts
from tallyloom.storage import materialize

OOV = "<OOV>"


def clean_features(df: DataFrame, drop_users: bool = True, positive: bool = True) -> DataFrame:
    """Cleaned ids, features and numbers; without blank features, user names (``@``) and, if asked, counts that aren't positive."""
    out = df.withColumns({"group_id": clean_group_id(F.col("group_id")), "feat": clean_text_value(F.col("feat")), "value": clean_number(F.col("value").cast("string")), "group_norm": clean_number(F.col("group_norm").cast("string"))})
    out = out.where(F.col("feat").isNotNull() & F.col("group_id").isNotNull())
    if drop_users:
        out = out.where(~F.col("feat").startswith("@"))
    return out.where(F.col("value") > 0) if positive else out


def merge_repeated(df: DataFrame, mode: str = "sum") -> DataFrame:
    """One row per (group_id, feat): value and group_norm summed, or with ``compat`` those of the row with the largest value."""
    if mode == "sum":
        return df.groupBy("group_id", "feat").agg(F.sum("value").alias("value"), F.sum("group_norm").alias("group_norm"))
    if mode == "compat":
        best = F.max(F.struct("value", "group_norm")).alias("_b")
        return df.groupBy("group_id", "feat").agg(best).select("group_id", "feat", "_b.value", "_b.group_norm")
    raise ValueError(f"no mode {mode}")


def fold_rare(df: DataFrame, share: float) -> DataFrame:
    """Features found in fewer than ``int(share * groups)`` rows become one ``<OOV>`` row per group with their summed value and group_norm.

    Every group gets an ``<OOV>`` row, with zeros if it has no rare feature.
    Rows of a feature are counted with a map-side combine; a frequent feature is a single row of the counts.
    """
    counts = df.groupBy("feat").agg(F.count(F.lit(1)).alias("_df"))
    groups = df.agg(F.count_distinct("group_id").alias("g")).scalar()
    marked = df.join(counts, "feat").withColumn("_rare", F.col("_df") < F.floor(F.lit(share) * groups))
    zero = lambda c: F.coalesce(F.sum(F.when(F.col("_rare"), F.col(c))), F.lit(0.0)).alias(c)
    oov = marked.groupBy("group_id").agg(zero("value"), zero("group_norm")).select("group_id", F.lit(OOV).alias("feat"), "value", "group_norm")
    return marked.where(~F.col("_rare")).select("group_id", "feat", "value", "group_norm").unionByName(oov)


def document_frequency(df: DataFrame) -> DataFrame:
    """Rows per feature."""
    return df.groupBy("feat").agg(F.count(F.lit(1)).alias("n_groups"))


def anscombe_rebase(df: DataFrame, year_range: tuple[str, str] | None = None, strip: bool = True) -> DataFrame:
    """Values after the Anscombe transform and group_norm as their share of the group's transformed sum.

    Features lose their punctuation (``can't`` and ``cant`` become two rows of
    one feature; see ``merge_repeated``); blank and ``@`` features are dropped; ``year_range`` keeps ids from its first up to its second text.
    """
    out = df.where(~F.col("feat").startswith("@"))
    if year_range:
        out = out.where(K.in_year_range(F.col("group_id"), *year_range))
    if strip:
        out = out.withColumn("feat", X.strip_punctuation(F.col("feat"))).where(F.trim("feat") != "")
    out = out.withColumn("value", N.anscombe(F.col("value")))
    return with_group_norm(out.drop("group_norm"))


def filter_vocabulary(df: DataFrame, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """Rows whose feature is a term of the vocabulary and whose group id is complete. Doing this before shares are formed changes them."""
    return df.where(K.complete_group(F.col("group_id"))).join(vocabulary.select(F.col(term).alias("feat")).distinct(), "feat", "left_semi")


def clamp_scores(df: DataFrame, score: str = "group_norm", low: float = 0.0, high: float = 5.0, categories: Sequence[str] | None = None, standardize: bool = False, recenter: bool = False, clamp_again: bool = False) -> DataFrame:
    """Scores clamped to [low, high]; then, if asked, as z-scores per feature (population sigma), moved back by the feature's mean, and clamped again.

    ``categories`` keeps only those features. Statistics of all features come from one aggregate; with sigma 0 the z-score is null.
    """
    if categories is not None:
        df = df.where(F.col("feat").isin(*categories))
    out = df.withColumn(score, N.clamp(F.col(score), low, high))
    if standardize:
        stats = out.groupBy("feat").agg(F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_sd"))
        z = (F.col(score) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
        out = out.join(stats, "feat").withColumn(score, z + F.col("_mean") if recenter else z).drop("_mean", "_sd")
        if clamp_again:
            out = out.withColumn(score, N.clamp(F.col(score), low, high))
    return out


def week_bounds(df: DataFrame, keys: Sequence[str] = ("yw", "feat"), score: str = "group_norm", sigmas: float = 3.0) -> DataFrame:
    """Per key: mean, sd (population), low and high = mean ∓ sigmas * sd."""
    stats = df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"))
    return stats.withColumns({"low": F.col("mean") - sigmas * F.col("sd"), "high": F.col("mean") + sigmas * F.col("sd")})


def reset_outliers(df: DataFrame, keys: Sequence[str] = ("yw", "feat"), score: str = "group_norm", sigmas: float = 3.0) -> DataFrame:
    """Scores outside their key's mean ∓ sigmas * sd are set to the mean; rows without a key part are dropped."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull() & (F.col(k) != ""))
    bounds = week_bounds(known, keys, score, sigmas).select(*keys, "mean", "low", "high")
    out = F.when((F.col(score) < F.col("low")) | (F.col(score) > F.col("high")), F.col("mean")).otherwise(F.col(score))
    return known.join(bounds, list(keys), "left").withColumn(score, out).drop("mean", "low", "high")


def scale_min_max(df: DataFrame, score: str = "group_norm", per: Sequence[str] = (), to_low: float = 0.0, to_high: float = 5.0) -> DataFrame:
    """Scores scaled to [to_low, to_high] by the least and greatest of all rows (or of each ``per``), rounded to three places."""
    if per:
        ends = df.groupBy(*per).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        out = df.join(ends, list(per))
        return out.withColumn(score, N.min_max(F.col(score), F.col("_lo"), F.col("_hi"), to_low, to_high)).drop("_lo", "_hi")
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    return df.withColumn(score, N.min_max(F.col(score), ends.select("lo").scalar(), ends.select("hi").scalar(), to_low, to_high))


def summarize(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """One row a column: name, n, mean, sd (sample), least, quartiles (interpolated), greatest."""
    named = columns.items() if isinstance(columns, Mapping) else [(c, F.col(c)) for c in columns]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in named])))
    out = long.groupBy("name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("greatest"))
    q = interpolated_percentiles(materialize(value_counts(long, ["name"], "x"), "values"), ["name"], (0.25, 0.5, 0.75))
    wide = q.groupBy("name").agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return out.join(wide, "name", "left").select("name", "n", "mean", "sd", "least", "q25", "q50", "q75", "greatest")
