"""Percentiles per group by exact bisection of value intervals.

For every group and percentile an interval of values is kept that holds the
target rank. Each pass counts the rows below the midpoints of the open
intervals and goes on with the part that holds the rank, until it has shrunk
to one value (exact) or to the tolerated width (bounded error). ``levels``
halvings are made in one pass, by counting below 2**levels - 1 midpoints at once.
What passes between tasks is counts per part, never the rows. Two forms of
partial results can be added over weeks or loads: ``group_counts`` per value,
exact, and ``group_sketch`` per logarithmic cell, small, with an error under 9 %.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.selection import merge_counts, merge_sketches, refine_ranks, value_counts, value_sketch
from tallyloom.storage import materialize

__all__ = ["bisect_percentiles", "group_counts", "group_rows", "group_sketch", "merge_counts", "merge_sketches", "rounded"]


def rounded(value: Column, digits: int) -> Column:
    """Values cut to ``digits`` significant binary digits below their power of two: a relative error under 2**-digits, and far fewer distinct values to keep."""
    scale = F.pow(F.lit(2.0), digits - F.floor(F.log2(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def group_rows(df: DataFrame, levels: Mapping[str, Mapping[str, Column]], value: Column, valid: Column) -> DataFrame:
    """One row for each valid row and level: level, one column for each group column (null where a level leaves it out), v.

    ``levels`` maps a level's name to its group columns, a column of one name being the same in all. Rows that aren't valid, or have a null in a group
    column of the level, are not counted. The needed columns are written once; levels are unfolded anew in every pass over them.
    """
    columns: dict[str, Column] = {}
    for own in levels.values():
        columns |= own
    base = materialize(df.where(valid).select(*[c.cast("string").alias(n) for n, c in columns.items()], value.cast("double").alias("_value")), "group-rows")
    some = lambda own: F.forall(F.array(*[F.col(n).isNotNull() for n in own]), lambda x: x) if own else F.lit(True)
    each = F.array(*[F.when(some(own), F.struct(F.lit(level).alias("level"), *[(F.col(n) if n in own else F.lit(None).cast("string")).alias(f"_{n}") for n in columns])) for level, own in levels.items()])
    rows = base.select("_value", F.inline(F.filter(each, lambda e: e.isNotNull())))
    return rows.select("level", *[F.col(f"_{n}").alias(n) for n in columns], F.col("_value").alias("v"))


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("v", "n")]


def group_counts(rows: DataFrame) -> DataFrame:
    """Exact partial results of ``group_rows``: its columns and n. Put them together with ``merge_counts``."""
    return value_counts(rows, _keys(rows), "v")


def group_sketch(rows: DataFrame) -> DataFrame:
    """Small partial results of ``group_rows``: counts per logarithmic cell. Put them together with ``merge_sketches``."""
    return value_sketch(rows, _keys(rows))


def bisect_percentiles(rows: DataFrame, percentiles: Sequence[float] = (0.5,), levels: int = 8, tolerance: float = 0.0) -> DataFrame:
    """Percentiles of ``group_rows`` or of written ``group_counts``: the group columns, percentile, n_rows, lo, hi.

    The percentile p of n values is the smallest value with at least ceil(p*n)
    values not above it, and lies in [lo, hi]; with tolerance 0 lo = hi and the
    result is exact. Groups without valid rows are absent; ties and repeated
    rows count each; an empty table gives an empty result.
    """
    return refine_ranks(rows, _keys(rows), percentiles, cells=2**levels, tolerance=tolerance).withColumnRenamed("q", "percentile")
