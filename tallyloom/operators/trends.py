"""Series over weeks, comparisons between years, and panels of places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import keys as K


def inner_weeks(places: DataFrame, week: str = "Time") -> DataFrame:
    """Without the first and the last week of all."""
    ends = places.agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    return places.where((F.col(week) > ends.select("lo").scalar()) & (F.col(week) < ends.select("hi").scalar()))


def weekly_series(places: DataFrame, feats: Sequence[str] = ("ANX_SCORE", "DEP_SCORE"), score: str = "wavg_score", week: str = "Time") -> DataFrame:
    """One row a week, without the first and last: yearweek, date (Thursday), n, and per feature avg, std (population), se = std / sqrt(n), up and down.

    n is the least number of places that any of the features has in the week.
    """
    rows = inner_weeks(places.where(F.col("feat").isin(*feats)), week)
    aggs = []
    for f in feats:
        x = F.when(F.col("feat") == f, F.col(score))
        aggs += [F.avg(x).alias(f"avg_{f}"), F.stddev_pop(x).alias(f"std_{f}"), F.count(x).alias(f"_n_{f}")]
    out = rows.groupBy(F.col(week).alias("yearweek")).agg(*aggs)
    n = F.least(*[F.col(f"_n_{f}") for f in feats]) if len(feats) > 1 else F.col(f"_n_{feats[0]}")
    out = out.withColumn("n", n).withColumn("date", K.week_days(F.col("yearweek"))["thursday"])
    for f in feats:
        se = F.col(f"std_{f}") / F.sqrt(F.nullif(F.col("n"), F.lit(0)).cast("double"))
        out = out.withColumn(f"se_{f}", se).withColumns({f"up_{f}": F.col(f"avg_{f}") + F.col(f"se_{f}"), f"down_{f}": F.col(f"avg_{f}") - F.col(f"se_{f}")})
    return out.drop(*[f"_n_{f}" for f in feats])


def mean_and_error(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, mean, sem = sample sigma / sqrt(n)."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    return out.withColumn("sem", F.col("_s") / F.sqrt(F.nullif(F.col("n"), F.lit(0)).cast("double"))).drop("_s")


def grain_means(df: DataFrame, value: str, grains: Sequence[Sequence[str]]) -> DataFrame:
    """Means at several grains from one pass (grouping sets): the grain columns (null where a grain leaves them out), grain, n, mean."""
    names = list(dict.fromkeys(c for g in grains for c in g))
    sets = [[F.col(c) for c in g] for g in grains]
    label = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    return df.groupingSets(sets, *names).agg(label.alias("grain"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def year_over_year(panel: DataFrame, place: str, week: str, value: str, later: str = "2020", earlier: str = "2019", also: Sequence[str] = ()) -> DataFrame:
    """place, week number (and ``also``), later and earlier value and diff = later − earlier + mean of all earlier values of both-year pairs."""
    keyed = panel.select(place, *also, F.substring_index(week, "_", 1).alias("_y"), F.substring_index(week, "_", -1).alias("week_no"), F.col(value).alias("_v"))
    keys = [place, "week_no", *also]
    pairs = keyed.where(F.col("_y") == later).select(*keys, F.col("_v").alias("later")).join(keyed.where(F.col("_y") == earlier).select(*keys, F.col("_v").alias("earlier")), keys)
    mean = pairs.agg(F.avg("earlier").alias("m")).scalar()
    return pairs.withColumn("diff", F.col("later") - F.col("earlier") + mean)


def center_within(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_mean`` of the entity and ``<column>_centered``. Means are aggregated and joined back, so no entity is gathered in a window."""
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    return df.join(means, entity).withColumns({f"{c}_centered": F.col(c) - F.col(f"{c}_mean") for c in columns})


def full_coverage(panel: DataFrame, place: str, week: str) -> DataFrame:
    """Rows of places that have a row in every week of the panel."""
    weeks = panel.agg(F.count_distinct(week).alias("w")).scalar()
    whole = panel.groupBy(place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == weeks).select(place)
    return panel.join(whole, place, "left_semi")


def largest_per(df: DataFrame, group: str, size: str, ties: bool = True) -> DataFrame:
    """The rows with the group's greatest ``size``: all of them with ``ties``, else one. The greatest is aggregated and joined back."""
    if ties:
        top = df.groupBy(group).agg(F.max(size).alias(size))
        return df.join(top, [group, size], "left_semi").select(*df.columns)
    return df.groupBy(group).agg(F.max_by(F.struct(*df.columns), F.struct(size, *[c for c in df.columns if c != size])).alias("_r")).select("_r.*")


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlations of all pairs of columns, long: keys, a, b, n, r (null where a variance is 0)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)).cast("double"), F.when(both, F.col(b)).cast("double")
        # corr() itself fails on a variance of 0 in ANSI mode
        r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
        aggs += [r.alias(f"_r{i}"), F.count_if(both).alias(f"_n{i}")]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_n{i}").alias("n"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), name, value)


def with_min_entries(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys that have at least ``least`` rows."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(enough, key, "left_semi")


def in_places(df: DataFrame, places: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Rows of the places that fulfil ``where`` (a region, a division, a list)."""
    chosen = places if where is None else places.where(where)
    return df.join(chosen.select(key).distinct(), key, "left_semi")


def mark_events(df: DataFrame, date: str, events: Mapping[str, tuple[str, str]], days: int = 7) -> DataFrame:
    """Adds events: the names, in order, of those whose first to last day overlap the ``days`` from the date on; empty without one, null without a date."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.to_date(F.lit(a)).alias("first"), F.to_date(F.lit(b)).alias("last")) for n, (a, b) in sorted(events.items())])
    on = F.filter(known, lambda e: (e["first"] < F.date_add(F.col(date), days)) & (e["last"] >= F.col(date)))
    return df.withColumn("events", F.when(F.col(date).isNotNull(), F.array_join(F.transform(on, lambda e: e["name"]), ", ")))


def before(df: DataFrame, column: str, end: str) -> DataFrame:
    """Rows dated before ``end``."""
    return df.where(F.col(column) < F.to_date(F.lit(end)))


def rolling_mean(series: DataFrame, order: str, value: str, width: int, keys: Sequence[str]) -> DataFrame:
    """Adds the mean of the last ``width`` rows of a key (a place's weeks)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return series.withColumn(f"{value}_rolling", F.avg(value).over(w))
