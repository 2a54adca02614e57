"""Distinct counts over identifier sets too large for one place, by disjoint hash ranges.

An identifier falls into one bucket by its hash, so buckets share no
identifier: a group's distinct count is the sum of its counts per bucket. Each
bucket keeps its distinct identifier-group pairs, so counts of any combination
of groups within it are exact. The error bound is therefore 0; what is bounded
instead is the part of the set that a task holds, by the number of buckets.
Pairs of separate days, counties or loads are merged bucket by bucket.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct pairs that a bucket is meant to hold at most; ``buckets_for`` takes the number of buckets from it.
PAIRS_PER_BUCKET = 2_000_000
LEAST_BUCKETS = 256


def buckets_for(n_pairs: int) -> int:
    """The number of buckets, a power of two, by which none of ``n_pairs`` pairs' buckets holds more than about PAIRS_PER_BUCKET; the number of rows is a safe estimate."""
    n = LEAST_BUCKETS
    while n * PAIRS_PER_BUCKET < n_pairs:
        n *= 2
    return n


def partial_pairs(df: DataFrame, identifier: Column, groups: Mapping[str, Column], buckets: int | None = None) -> DataFrame:
    """The mergeable partial result: buckets (their number), bucket, the group columns, id; each distinct pair once.

    ``buckets`` must be a power of two; by default it follows from df's number of rows.
    Null identifiers are dropped; null group values are kept as a group of
    their own. Pairs are made distinct on the map side before they are shuffled, so a
    group or an identifier with a third of all rows costs no more than its distinct pairs.
    """
    buckets = buckets or buckets_for(df.count())
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    pairs = df.select(*[c.alias(n) for n, c in groups.items()], identifier.alias("id")).where(F.col("id").isNotNull())
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    return pairs.select(F.lit(buckets).alias("buckets"), bucket.alias("bucket"), *groups, "id").distinct()


def merge_pairs(parts: Sequence[DataFrame]) -> DataFrame:
    """Partial results with the same groups put together; pairs found in several count once.

    Parts may differ in their number of buckets: a bucket of the greater number lies within one of the smaller, so all take the least one.
    """
    least = [part.agg(F.min("buckets")).first()[0] for part in parts]
    n = min((x for x in least if x), default=LEAST_BUCKETS)
    same = [part.withColumns({"bucket": F.pmod("bucket", F.lit(n)), "buckets": F.lit(n)}) for part in parts]
    return functools.reduce(DataFrame.unionByName, same).distinct()


def count_distinct(pairs: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct identifiers of every level: level, the group columns (null where a level leaves them out), n_distinct.

    ``levels`` names the group columns of each combination; an empty one is the
    grand total. Pairs are brought together by bucket once; the levels are
    unfolded, made distinct and counted within the bucket without another
    shuffle of pairs, and only the counts per bucket are added across buckets.
    An empty table gives no rows.
    """
    groups = [c for c in pairs.columns if c not in ("buckets", "bucket", "id")]
    types = dict(pairs.dtypes)
    unfold = F.array(
        *[
            F.struct(F.lit(name).alias("level"), *[(F.col(g) if g in own else F.lit(None).cast(types[g])).alias(f"_{g}") for g in groups])
            for name, own in levels.items()
        ]
    )
    together = pairs.repartition("bucket")
    each = together.select("bucket", "id", F.inline(unfold))
    names = [f"_{g}" for g in groups]
    within = each.groupBy("bucket", "id", "level", *names).agg(F.lit(1).alias("one")).groupBy("bucket", "level", *names).agg(F.count(F.lit(1)).alias("c"))
    return within.groupBy("level", *names).agg(F.sum("c").alias("n_distinct")).select("level", *[F.col(f"_{g}").alias(g) for g in groups], "n_distinct")
