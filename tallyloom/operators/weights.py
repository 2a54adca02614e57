"""Post-stratification weights and the redistribution of predicted incomes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import numeric as N
from tallyloom.operators.selection import interpolated_percentiles, value_counts
from tallyloom.storage import materialize

#: Edges and shares of the target income distribution.
TARGET_EDGES = (0.0, 30_000.0, 50_000.0, 75_000.0)
TARGET_SHARES = (0.198889, 0.204738, 0.242761, 0.353612)


@dataclass(frozen=True)
class Demographic:
    """A measured value, its bin edges and the census columns (percentages) of its bins."""

    name: str
    edges: tuple[float, ...]
    census: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(self.census) != len(self.edges) - 1:
            raise ValueError("one census column per bin")


#: Edges of the ten income bins, the outer ones open.
INCOME = Demographic("income", (0.0, *map(float, N.INCOME_EDGES), float("inf")), tuple(f"pct_{i}" for i in range(1, 11)))


#: Edges of the other demographics' bins; the census shares are percentages a bin.
AGE = Demographic("age", (13.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0, 55.0, 60.0, 65.0, 81.0), tuple(f"age_{i}" for i in range(1, 12)))
GENDER = Demographic("gender", (0.0, 1.0, 5.0), ("male", "female"))
EDUCATION = Demographic("education", (0.0, 1.0, 5.0), ("high_school", "bachelor"))


def bin_shares(users: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = ("cnty", "yw")) -> DataFrame:
    """keys, bin (from 0), n, total, share: users per bin of the complete bin grid over all users of the key, also those in no bin."""
    bins = N.histogram_bin(F.col(value), list(edges))
    counts = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(bins == b).alias(f"b{b}") for b in range(len(edges) - 1)])
    grid = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"b{b}").alias("n")) for b in range(len(edges) - 1)])
    return counts.select(*keys, "total", F.inline(grid)).withColumn("share", F.col("n") / F.col("total"))


def _weight(n: Column, total: Column, pct: Column, k: float, uninformed: bool, n_bins: int) -> Column:
    p = (n + 1) / (total + n_bins) if uninformed else (n + k * pct / 100) / F.nullif(total + k, F.lit(0.0))
    return F.when(p > 0, pct / (100 * F.nullif(p, F.lit(0.0)))).otherwise(0.0)


def poststratify(users: DataFrame, census: DataFrame, dem: Demographic = INCOME, k: float = 10.0, uninformed: bool = False, min_bin: float = 0, smooth_first: bool = False) -> DataFrame:
    """Adds the weight of every user (user_id, cnty, yw and the demographic's value): population share over smoothed sample share of the user's bin.

    A user takes the first bin whose upper edge exceeds the value: values below
    the range take the first bin's weight, those at or above the last edge none (null). Counties not in the census are dropped.
    With ``min_bin`` 0 everything is a closed form over one aggregate of bin
    counts; otherwise small bins are merged first, per (cnty, yw), over these counts only.
    """
    if min_bin > 0:
        return _poststratify_collapsed(users, census, dem, k, uninformed, min_bin, smooth_first)
    keys = ["cnty", "yw"]
    m = len(dem.edges) - 1
    bins = N.histogram_bin(F.col(dem.name), list(dem.edges))
    counts = users.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_t"), *[F.count_if(bins == b).cast("double").alias(f"_n{b}") for b in range(m)])
    pct = [F.col(c).cast("double") for c in dem.census]
    if m > 1:
        pct[-1] = 100 - sum(pct[1:-1], pct[0])  # what is left belongs to the last bin
    weights = [_weight(F.col(f"_n{b}"), F.col("_t"), pct[b], k, uninformed, m) if m > 1 else F.lit(1.0) for b in range(m)]
    table = counts.join(census, "cnty").select(*keys, F.array(*weights).alias("_w"))
    place = F.lit(None).cast("int")
    for b in range(m - 1, -1, -1):
        place = F.when(F.col(dem.name) < dem.edges[b + 1], b + 1).otherwise(place)
    return users.join(table, keys).withColumn("weight", F.try_element_at("_w", place)).drop("_w")


def collapse(counts: Sequence[float], edges: Sequence[float], least: float) -> tuple[list[float], list[float]]:
    """Bins below ``least`` merged: always the smallest (the first of equal ones) into its smaller neighbour, into the right one if both are equal; outer bins inward. Returns counts and edges."""
    c, e = list(counts), list(edges)
    while len(c) > 1 and min(c) < least:
        i = c.index(min(c))
        right = i == 0 or (i < len(c) - 1 and c[i + 1] <= c[i - 1])
        j = i + 1 if right else i - 1
        c[j] += c[i]
        del e[i + 1 if right else i]
        del c[i]
    return c, e


def collapsed_weights(counts: Sequence[float], total: float, percentages: Sequence[float], edges: Sequence[float], k: float, uninformed: bool, least: float, smooth_first: bool) -> tuple[list[float], list[float]]:
    """Edges and weights of the bins that are left after merging."""
    n = [float(x) for x in counts]
    first = [x + k * p / 100 for x, p in zip(n, percentages)] if smooth_first else n
    left, e = collapse(first, edges, least)
    if smooth_first:
        k = 0.0
    if len(e) < 3:
        return e, [1.0]
    pct = []
    for low, high in zip(e[:-2], e[1:-1]):
        pct.append(sum(p for p, a in zip(percentages, edges) if low <= a < high))
    pct.append(100 - sum(pct))
    out = []
    for x, p in zip(left, pct):
        x = float(np.round(x))
        share = (x + 1) / (total + len(left)) if uninformed else (x + k * p / 100) / (total + k)
        out.append(p / (100 * share) if share > 0 else 0.0)
    return e, out


def _poststratify_collapsed(users: DataFrame, census: DataFrame, dem: Demographic, k: float, uninformed: bool, min_bin: float, smooth_first: bool) -> DataFrame:
    keys = ["cnty", "yw"]
    m = len(dem.edges) - 1
    bins = N.histogram_bin(F.col(dem.name), list(dem.edges))
    counts = users.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("total"), F.array(*[F.count_if(bins == b).cast("double") for b in range(m)]).alias("n"))
    table = counts.join(census, "cnty").select(*keys, "total", "n", F.array(*[F.col(c).cast("double") for c in dem.census]).alias("pct"))

    def run(batches):
        for batch in batches:
            both = [collapsed_weights(n, t, p, dem.edges, k, uninformed, min_bin, smooth_first) for n, t, p in zip(batch["n"], batch["total"], batch["pct"])]
            yield pd.DataFrame({"cnty": batch["cnty"], "yw": batch["yw"], "uppers": [b[0][1:] for b in both], "weights": [b[1] for b in both]})

    kind = {f.name: f.dataType.simpleString() for f in users.schema.fields}
    merged = table.mapInPandas(run, f"cnty {kind['cnty']}, yw {kind['yw']}, uppers array<double>, weights array<double>")
    x = F.col(dem.name)
    place = F.size(F.filter("uppers", lambda u: u <= x)) + 1
    weight = F.when(F.size("weights") == 1, 1.0).when(x.isNotNull(), F.try_element_at("weights", place))
    return users.join(merged, keys).withColumn("weight", weight).drop("uppers", "weights")


def redistribute_incomes(users: DataFrame, income: str = "income", edges: Sequence[float] = TARGET_EDGES, shares: Sequence[float] = TARGET_SHARES, repair_top: bool = False) -> DataFrame:
    """Adds income_redist: incomes mapped so that their distribution follows the target shares.

    Source edges are 0 and the exact percentiles at the cumulated shares (linear interpolation); every
    source bin is mapped linearly onto its target bin, the last of which ends at
    one above the greatest income rounded up. Incomes below 0 and the greatest income itself are in no bin: null, or
    with ``repair_top`` the greatest gets the last target edge. The percentiles are selected by refining histograms; only one number a bin comes to the driver.
    """
    cum = np.cumsum(shares)
    at = [*map(float, cum[:-1]), 1.0]
    found = interpolated_percentiles(materialize(value_counts(users, [], income), "incomes"), [], at).collect()  # one number a bin
    p = [v for _, v in sorted((r.q, r.value) for r in found)]
    x = F.col(income)
    out = F.lit(None).cast("double")
    if not p:
        return users.withColumn("income_redist", out)
    top = float(math.ceil(p[-1]) + 1)
    for b in range(len(shares) - 1, -1, -1):
        low = F.lit(0.0 if b == 0 else p[b - 1])
        high = F.lit(p[b])
        to_high = F.lit(top if b == len(shares) - 1 else edges[b + 1])
        out = F.when((x >= low) & (x < high), N.rescale(x, low, high, F.lit(edges[b]), to_high)).otherwise(out)
    if repair_top:
        out = F.when(x == p[-1], F.lit(top)).otherwise(out)
    return users.withColumn("income_redist", out)


def fill_from(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of ``target`` replaced by those of ``source`` where it has the key and a value; other rows untouched."""
    renamed = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = target.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns]).select(*target.columns)
