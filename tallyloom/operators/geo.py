"""Places and weights on feature tables, and their aggregation to place and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions.cleaning import clean_group_id, group_entity, pad_county

GRAINS = ("week", "month", "year")


def user_counties(mapping: DataFrame, user: str = "user_id", county: str = "cnty", position: str | None = None) -> DataFrame:
    """One padded county per user: the last by ``position``, or the greatest county without one. Null users and counties are dropped."""
    rows = mapping.where(F.col(user).isNotNull() & F.col(county).isNotNull())
    value = pad_county(F.col(county).cast("string"))
    order = F.col(position) if position else F.col(county)
    return rows.groupBy(F.col(user).cast("string").alias("entity")).agg(F.max_by(value, order).alias("cnty"))


def group_weights(mapping: DataFrame, group: str = "user_id", weight: str = "weight", position: str | None = None) -> DataFrame:
    """One weight per group id: the last by ``position``, or the greatest without one. Ids that start with a colon and null weights are dropped."""
    rows = mapping.withColumn("_g", clean_group_id(F.col(group))).where(F.col("_g").isNotNull() & ~F.col("_g").startswith(":") & F.col(weight).isNotNull())
    order = F.col(position) if position else F.col(weight)
    return rows.groupBy(F.col("_g").alias("group_id")).agg(F.max_by(weight, order).alias("weight"))


def add_county(features: DataFrame, counties: DataFrame) -> DataFrame:
    """Adds the county of the user in group_id; rows of users without one are dropped. Users are text, so malformed ids match nobody."""
    return features.withColumn("_e", group_entity(F.col("group_id"))).join(counties.withColumnRenamed("entity", "_e"), "_e").drop("_e")


def without_county(features: DataFrame, counties: DataFrame) -> DataFrame:
    """The rows that ``add_county`` drops."""
    return features.withColumn("_e", group_entity(F.col("group_id"))).join(counties.withColumnRenamed("entity", "_e"), "_e", "left_anti").drop("_e")


def add_weight(features: DataFrame, weights: DataFrame, default: float = 1.0) -> DataFrame:
    """Adds the weight of group_id, ``default`` where there is none; rows whose id starts with a colon are dropped."""
    rows = features.where(F.col("group_id").isNotNull() & ~F.col("group_id").startswith(":"))
    return rows.join(weights, "group_id", "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def reweight(features: DataFrame, weights: DataFrame, unmatched: str = "keep") -> DataFrame:
    """value and group_norm times the group's weight; groups without one stay as they are (``keep``), are dropped (``drop``) or are all that is given back (``only``)."""
    if unmatched == "only":
        return features.join(weights, "group_id", "left_anti")
    joined = features.join(weights.withColumnRenamed("weight", "_w"), "group_id", "left" if unmatched == "keep" else "inner")
    w = F.coalesce("_w", F.lit(1.0))
    return joined.withColumns({"value": F.col("value") * w, "group_norm": F.col("group_norm") * w}).drop("_w")


def spread_super_counties(features: DataFrame, mapping: DataFrame, super_county: str = "super_cnty", weight: str = "super_weight") -> DataFrame:
    """Rows of counties that are reliable alone, and rows of the others moved to their super-county.

    ``mapping`` has cnty, ``super_county`` and ``weight``: 1 keeps a county, a weight
    below 1 gives its part in a super-county, 0, null or no entry drops it. Values of a super-county row are the weighted mean over
    its (week, super-county, feature); such means are aggregated with a
    map-side combine and joined back to their rows.
    """
    rows = features.join(mapping.na.drop(), "cnty", "left").withColumn("_w", F.coalesce(weight, F.lit(0.0))).where(F.col("_w") > 0)
    alone = rows.where(F.col("_w") == 1.0).drop("_w", super_county, weight)
    parts = rows.where(F.col("_w") != 1.0)
    keys = ["yw", super_county, "feat"]
    means = parts.groupBy(*keys).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("_v"), (F.sum(F.col("group_norm") * F.col("_w")) / F.sum("_w")).alias("_n"))
    moved = parts.join(means, keys).withColumns({"value": F.col("_v"), "group_norm": F.col("_n"), "cnty": F.col(super_county)})
    return alone.unionByName(moved.select(*alone.columns))


def grain_key(grain: str) -> Column:
    gid, cnty = F.col("group_id"), F.col("cnty")
    return {"week": K.week_county, "month": K.month_county, "year": K.year_county}[grain](gid, cnty)


def aggregate_places(features: DataFrame, grain: str = "week", extra: Sequence[Column] = ()) -> DataFrame:
    """Scores of place and time: key, feat, sum_N_lexwords, wavg_score, avg_score, std_score, wstd_score, N_users, Space, Time.

    ``features`` has group_id, feat, value, group_norm, cnty and weight. wavg is
    weighted, avg and std (population) are not, wstd is the weighted sigma from the same sums.
    Malformed keys are dropped. Users are counted exactly by making (key, feat, user) distinct first, all other sums being additive over it, so
    a place with a large part of all rows is combined on the map side.
    """
    keyed = features.withColumn("key", grain_key(grain)).where(F.col("key").isNotNull() & F.col("feat").isNotNull())
    x, w = F.col("group_norm"), F.col("weight")
    per_user = keyed.groupBy("key", "feat", group_entity(F.col("group_id")).alias("_u")).agg(
        F.count(x).alias("_n"), F.sum("value").alias("_v"), F.sum(x).alias("_x"), F.sum(x * x).alias("_xx"), F.sum(F.when(x.isNotNull(), w)).alias("_w"), F.sum(x * w).alias("_xw"), F.sum(x * x * w).alias("_xxw")
    )
    sums = per_user.groupBy("key", "feat").agg(*[F.sum(c).alias(c) for c in ("_n", "_v", "_x", "_xx", "_w", "_xw", "_xxw")], F.count("_u").alias("N_users"), *extra)
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    n, sw = F.nullif(F.col("_n"), F.lit(0)), F.nullif(F.col("_w"), F.lit(0.0))
    return sums.select(
        "key",
        "feat",
        F.col("_v").alias("sum_N_lexwords"),
        (F.col("_xw") / sw).alias("wavg_score"),
        (F.col("_x") / n).alias("avg_score"),
        root(F.col("_xx") / n - F.pow(F.col("_x") / n, 2)).alias("std_score"),
        root(F.col("_xxw") / sw - F.pow(F.col("_xw") / sw, 2)).alias("wstd_score"),
        "N_users",
        F.substring_index("key", ":", -1).alias("Space"),
        F.substring_index("key", ":", 1).alias("Time"),
    )


def with_min_users(places: DataFrame, least: int) -> DataFrame:
    """Rows of at least ``least`` users, without the ``_int`` feature and rows with a blank place or time."""
    return places.where((F.col("N_users") >= least) & (F.col("feat") != "_int") & (F.col("Space") != "") & (F.col("Time") != ""))
