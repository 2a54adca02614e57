"""Weighted lexicons: reading, and scoring of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERCEPT = "_intercept"


def last_weights(lexicon: DataFrame, position: str | None = None) -> DataFrame:
    """term, category, weight with one row per (term, category): the last by ``position``, or the greatest weight without one. Rows with a null are dropped."""
    order = F.col(position) if position else F.col("weight")
    known = lexicon.where(F.col("term").isNotNull() & F.col("category").isNotNull() & F.col("weight").isNotNull())
    return known.groupBy("term", "category").agg(F.max_by("weight", order).alias("weight"))


def vocabulary(lexicon: DataFrame) -> DataFrame:
    """The distinct terms."""
    return lexicon.select("term").where(F.col("term").isNotNull()).distinct()


def intercepts(weights: DataFrame) -> DataFrame:
    """category, intercept."""
    return weights.where(F.col("term") == INTERCEPT).select("category", F.col("weight").alias("intercept"))


def score(features: DataFrame, weights: DataFrame, emit_intercept_only: bool = True, weighted_counts: bool = False) -> DataFrame:
    """Scores of groups: group_id, category, value, score (and weighted_value).

    value is the sum of the counts of a category's terms, score the sum of
    group_norm * weight plus the category's intercept. With
    ``emit_intercept_only`` every group has a row for every category with an
    intercept, value 0 if it has none of its terms. ``features`` should have one
    row per (group_id, feat); the intercept is never matched as a term.
    The features are read once: those without a term end, map-side combined, in one row of their group.
    """
    terms = weights.where(F.col("term") != INTERCEPT).withColumnRenamed("term", "feat")
    matched = F.col("category").isNotNull()
    sums = features.join(terms, "feat", "left" if emit_intercept_only else "inner").groupBy("group_id", "category").agg(
        F.sum(F.when(matched, F.col("value"))).alias("value"), F.sum(F.col("group_norm") * F.col("weight")).alias("s"), F.sum(F.col("value") * F.col("weight")).alias("weighted_value")
    )
    # a group's few categories side by side: those it has, and with intercepts all that have one
    entry = F.struct("category", "value", "s", "weighted_value")
    per = sums.groupBy("group_id").agg(F.collect_list(F.when(matched, entry)).alias("_own"))
    per = per.withColumn("_base", intercepts(weights).agg(F.collect_list(F.struct("category", "intercept")).alias("b")).scalar())
    base = F.col("_base")
    names = F.transform("_own", lambda o: o["category"])
    if emit_intercept_only:
        names = F.array_union(names, F.transform(base, lambda b: b["category"]))
    out = per.select("group_id", "_own", "_base", F.explode(names).alias("category"))
    own = F.try_element_at(F.filter("_own", lambda o: o["category"] == F.col("category")), F.lit(1))
    intercept = F.try_element_at(F.filter(base, lambda b: b["category"] == F.col("category")), F.lit(1))["intercept"]
    extra = [F.coalesce(own["weighted_value"], F.lit(0.0)).alias("weighted_value")] if weighted_counts else []
    return out.select("group_id", "category", F.coalesce(own["value"], F.lit(0.0)).alias("value"), (F.coalesce(own["s"], F.lit(0.0)) + F.coalesce(intercept, F.lit(0.0))).alias("score"), *extra)


def category_counts(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Summed counts of a category's terms, whatever their weights: group_id, category, value."""
    terms = weights.where(F.col("term") != INTERCEPT).select(F.col("term").alias("feat"), "category").distinct()
    return features.join(terms, "feat").groupBy("group_id", "category").agg(F.sum("value").alias("value"))
