"""Arithmetic on scores and incomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper edges of the first nine income bins; the tenth is open.
INCOME_EDGES = (10_000, 15_000, 25_000, 35_000, 50_000, 75_000, 100_000, 150_000, 200_000)


def anscombe(x: Column) -> Column:
    """2 * sqrt(x + 3/8); null or malformed counts give 0."""
    return F.coalesce(2 * F.sqrt(x.try_cast("double") + 0.375), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 5.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rescale(x: Column, from_low: Column, from_high: Column, to_low: Column, to_high: Column) -> Column:
    """Linear map of [from_low, from_high] onto [to_low, to_high]; an empty source interval gives to_low."""
    width = from_high - from_low
    return F.when(width == 0, to_low).otherwise((x - from_low) / F.nullif(width, F.lit(0.0)) * (to_high - to_low) + to_low)


def min_max(x: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 5.0, places: int = 3) -> Column:
    """Min-max scaling, rounded; where low = high the middle of the target."""
    middle = (to_low + to_high) / 2
    scaled = (x - low) / F.nullif(high - low, F.lit(0.0)) * (to_high - to_low) + to_low
    return F.round(F.when(high == low, F.lit(middle)).otherwise(scaled), places)


def bin_below(x: Column, edges: Sequence[float]) -> Column:
    """1 for x below the first edge, 2 below the second …, one more than there are edges at or above the last; null for null and NaN."""
    out = None
    for i, e in enumerate(edges, 1):
        out = F.when(x < e, i) if out is None else out.when(x < e, i)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), out.otherwise(len(edges) + 1))


def income_bin(income: Column) -> Column:
    """One of ten income bins, left-closed; negative incomes fall into the first."""
    return bin_below(income, INCOME_EDGES)


def income_from_log(predicted: Column) -> Column:
    return F.exp(predicted)


def histogram_bin(x: Column, edges: Sequence[float]) -> Column:
    """Index from 0 of the left-closed bin that holds x, the last bin closed on both sides; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        upper = (x <= edges[i + 1]) if i == len(edges) - 2 else (x < edges[i + 1])
        out = F.when((x >= edges[i]) & upper, i).otherwise(out)
    return out
