"""Feature tables: n-grams per group with their counts and shares."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X


def extract_ngrams(
    df: DataFrame,
    group: str,
    message: str,
    sizes: Sequence[int] = (1,),
    tokenize: Callable[[Column], Column] = X.tokens,
    whitelist: str | None = None,
    min_value: int = 1,
    binary: bool = False,
    value_func: Callable[[Column], Column] | None = None,
    lower: bool = True,
    norm: bool = True,
) -> DataFrame:
    """The feature table of messages: group_id, feat, value, group_norm (and n, if several sizes are asked for).

    value is the n-gram's count in the group; group_norm its share of all the
    group's n-grams of that size, before ``min_value`` takes rare ones away, or 1 with
    ``binary``; ``value_func`` is applied to the count before shares are formed. Rows with a null or empty group or message are dropped, as are messages with too
    few tokens. ``whitelist`` names an array column of the known tokens (see ``text.whitelisted_ngrams``). All sizes come from one pass over the tokens; counts are
    combined on the map side, and totals are sums of these counts. Without ``norm`` only all counts are given, to be written before shares are formed.
    """
    rows = df.where(F.col(group).isNotNull() & (F.col(group) != "") & F.col(message).isNotNull() & (F.col(message) != ""))
    rows = rows.select(F.col(group).cast("string").alias("group_id"), tokenize(F.col(message)).alias("_t"), *([whitelist] if whitelist else []))
    grams = lambda n: X.ngrams(F.col("_t"), n) if whitelist is None else X.whitelisted_ngrams(F.col("_t"), n, F.col(whitelist))
    each = rows.select("group_id", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), grams(n).alias("_g")) for n in sizes])))
    each = each.select("group_id", "n", F.explode("_g").alias("feat"))
    if lower:
        each = each.withColumn("feat", F.lower("feat"))
    counted = each.groupBy("group_id", "n", "feat").agg(F.count(F.lit(1)).cast("double").alias("value"))
    if value_func:
        counted = counted.withColumn("value", value_func(F.col("value")))
    many = ["n"] if len(sizes) > 1 else []
    if not norm:
        return counted.select("group_id", *many, "feat", "value")
    out = with_group_norm(counted, ["group_id", "n"], binary=binary).where(F.col("value") >= min_value)
    return out.select("group_id", *many, "feat", "value", "group_norm")


def with_group_norm(features: DataFrame, group: Sequence[str] = ("group_id",), value: str = "value", name: str = "group_norm", binary: bool = False) -> DataFrame:
    """Adds each value's share of its group's sum; 1 with ``binary``, null where the sum is 0.

    Totals are aggregated with a map-side combine and joined back, so a group
    with a large part of all features is not sorted in one task as a window would.
    """
    if binary:
        return features.withColumn(name, F.lit(1.0))
    totals = features.groupBy(*group).agg(F.sum(value).alias("_total"))
    return features.join(totals, list(group)).withColumn(name, F.col(value) / F.nullif(F.col("_total"), F.lit(0.0))).drop("_total")
