"""Exact selection of ranks per key by refining value histograms whose counts can be added.

The first pass counts the values of every key in logarithmic cells
(``value_sketch``): map-side combined, so a hot key sends at most its few
hundred cells from each task, and mergeable over loads, weeks or partitions.
The cell that holds a rank becomes its interval. Every further pass reads the
rows again, cuts each open interval into equal cells, counts the rows of each
cell, and goes on with the one that holds the rank, narrowed to the smallest
and largest value seen in it; an interval with few rows is cut into its single
values. A rank is resolved when both ends are equal. Only cells are shuffled;
no task or driver ever holds a key's values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import finite
from tallyloom.storage import join_checked, materialize

#: Cells of the first pass per doubling of the value.
PER_OCTAVE = 8
#: Rows up to which an open interval is cut into its single values.
FEW = 4096
#: A key with at least this part of all rows is hot: there can be no more than its inverse of them, so their open intervals are a table of bounded size.
HOT_PART = 1 / 1000
#: Stored bytes up to which the other keys' open intervals are broadcast; in memory they take several times as much.
COLD_BYTES = 1 << 20
#: Passes after which a rank must be resolved: the first leaves intervals of one sign within 9 %, each other takes ``cells`` off their width.
MAX_PASSES = 64


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact mergeable form of the finite values per key: keys, v, n. Add n over such tables to combine them."""
    return df.where(finite(F.col(value))).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Put results of separate loads, weeks or partitions together."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    keys = [c for c in whole.columns if c not in ("v", "n")]
    return whole.groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def log_cell(v: Column) -> Column:
    """The logarithmic cell of a value: it grows with the value; 0 for 0 and null for null."""
    place = F.floor(F.log2(F.abs(v)) * PER_OCTAVE).cast("int") + 1_000_000
    return F.when(v > 0, place).when(v < 0, -place).when(v == 0, 0)


def value_sketch(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram of logarithmic cells per key: keys, cell, n, total, mn, mx. ``rows`` has v, and n if a row stands for several.

    Rows whose v is null or not finite are counted in a cell of their own, without value. A
    quantile read off a cell is wrong by less than 2 ** (1 / PER_OCTAVE) - 1,
    9 %, at either end. Put sketches together with ``merge_sketches``.
    """
    rows = rows.withColumn("v", F.when(finite(F.col("v")), F.col("v")))
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    total = F.sum(F.col("v") * F.col("n")) if "n" in rows.columns else F.sum("v")
    return rows.groupBy(*keys, log_cell(F.col("v")).alias("cell")).agg(n.alias("n"), total.alias("total"), F.min("v").alias("mn"), F.max("v").alias("mx"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of separate loads, weeks or partitions put together."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    keys = [c for c in whole.columns if c not in ("cell", "n", "total", "mn", "mx")]
    return whole.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def _chosen(counted: DataFrame, by: Sequence[str], ranks: Callable[[], Column]) -> DataFrame:
    """The cells that hold a rank: those of ``counted`` (by, cell, n, mn, mx, and what ``ranks`` reads) with ``want``, the (q, rank) in them, ranks counted from the cell's start."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # over a key's cells
    placed = counted.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("n"))
    inside = F.filter(ranks(), lambda w: (w["rank"] > F.col("_below")) & (w["rank"] <= F.col("_upto")))
    moved = F.transform(inside, lambda w: F.struct(w["q"].alias("q"), (w["rank"] - F.col("_below")).alias("rank")))
    return placed.withColumn("want", moved).where(F.size("want") > 0).drop("_upto", "_below")


def refine_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    quantiles: Sequence[float],
    cells: int = 256,
    tolerance: float = 0.0,
    rank_of: Callable[[Column, Column], Column] | None = None,
    sketch: DataFrame | None = None,
    few: int = FEW,
    limit: int = COLD_BYTES,
) -> DataFrame:
    """Quantiles per key: keys, q, n_rows, lo, hi; the quantile lies in [lo, hi].

    ``rows`` has the keys, v and, if a row stands for several, n; each pass
    reads it, so it should come from a written table. Null and non-finite
    values are passed over. The q-quantile is the smallest value with at least ``ceil(q * n)`` values
    not above it (the least value for q = 0); ``rank_of`` may give another rank for q and the number of values. With ``tolerance`` 0 every rank
    is narrowed until lo = hi, which is exact; otherwise until
    ``hi - lo <= tolerance``. Keys without values are absent; an empty table gives an empty one.
    Null keys form a key of their own. ``sketch`` may be the rows' written ``value_sketch``.

    Open intervals of hot keys are broadcast, as there can be no more than
    1 / HOT_PART such keys; rows of the other keys, none of which is large, meet
    theirs in a join that shuffles both beyond ``limit`` stored bytes.
    """
    keys = list(keys)
    if cells < 2:
        raise ValueError("cells must be at least 2")
    rows = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "v", *(["n"] if "n" in rows.columns else [])).where(finite(F.col("v")))
    ks = [f"k{i}" for i in range(len(keys))]
    if sketch is None:
        sketch = materialize(value_sketch(rows, ks), "sketch")
    else:
        sketch = sketch.where(F.col("cell").isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "cell", "n", "mn", "mx")
    total = sketch.agg(F.sum("n")).first()[0] or 0
    n_rows = F.sum("n").over(Window.partitionBy(*ks))
    rank = rank_of if rank_of else lambda q, n: F.ceil(F.round(q * n, 6))
    ranks = lambda: F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1).cast("long"), F.least(F.col("n_rows"), rank(F.lit(float(q)), F.col("n_rows")).cast("long"))).alias("rank")) for q in quantiles])
    first = _chosen(sketch.withColumn("n_rows", n_rows), ks, ranks)
    state = materialize(first.select(F.monotonically_increasing_id().alias("id"), *ks, "n_rows", F.col("n").alias("c"), F.col("mn").alias("lo"), F.col("mx").alias("hi"), "want"), "ranks")
    is_open = (F.col("hi") - F.col("lo")) > tolerance
    done = state.where(~is_open)
    for _ in range(MAX_PASSES):
        opened = state.where(is_open)
        if opened.isEmpty():
            break
        counted = _count_cells(rows, opened, ks, cells, few, total * HOT_PART, limit)
        own = opened.select("id", *ks, "n_rows", F.col("want").alias("_want")).hint("merge")  # by id on both sides, as the window over an interval's cells
        chosen = _chosen(counted.join(own, "id"), ["id"], lambda: F.col("_want"))
        state = materialize(chosen.select(F.monotonically_increasing_id().alias("id"), *ks, "n_rows", F.col("n").alias("c"), F.col("mn").alias("lo"), F.col("mx").alias("hi"), "want"), "ranks")
        done = done.unionByName(state.where(~is_open))
    else:
        raise RuntimeError(f"ranks not resolved after {MAX_PASSES} passes")
    return done.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.inline("want"), "n_rows", "lo", "hi").select(*keys, "q", "n_rows", "lo", "hi")


def _count_cells(rows: DataFrame, opened: DataFrame, ks: Sequence[str], cells: int, few: int, hot_rows: float, limit: int) -> DataFrame:
    """Rows of the open intervals by cell: id, cell, n, mn, mx. Cells are single values in intervals of up to ``few`` rows."""
    h = F.xxhash64(*ks) if ks else F.lit(0).cast("long")
    packed = opened.groupBy(*ks).agg(F.max("n_rows").alias("_n"), F.collect_list(F.struct("id", "lo", "hi", (F.col("c") <= few).alias("few"))).alias("_open"))  # at most one entry a quantile
    packed = materialize(packed.select(*[F.col(k).alias(f"_{k}") for k in ks], h.alias("_h"), "_n", "_open"), "open-ranks")
    hot, cold = packed.where(F.col("_n") >= hot_rows).drop("_n"), packed.where(F.col("_n") < hot_rows).drop("_n")
    same = F.lit(True)
    for k in ks:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    data = rows.withColumn("_h", h)
    parts = []
    if not hot.isEmpty():
        parts.append(data.join(F.broadcast(hot), "_h").where(same))
        if not cold.isEmpty():  # rows of hot keys stay out of the shuffle
            data = data.join(F.broadcast(hot.select(F.col("_h").alias("_hot"), *[f"_{k}" for k in ks])), (F.col("_h") == F.col("_hot")) & same, "left_anti")
    if not cold.isEmpty():
        parts.append(join_checked(data, materialize(cold, "open-cold"), ["_h"], "inner", limit).where(same))
    hits = []
    for part in parts:
        i = F.filter("_open", lambda s: (F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"]))
        hit = part.select("v", *(["n"] if "n" in rows.columns else []), F.inline(i))
        # halves, so that hi - lo can't overflow
        at = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * cells
        cell = F.when(F.col("few"), F.col("v")).otherwise(F.least(F.lit(float(cells - 1)), F.floor(at).cast("double")))
        cell = F.coalesce(F.when(F.col("hi") / 2 == F.col("lo") / 2, F.when(F.col("v") > F.col("lo"), 1.0).otherwise(0.0)).otherwise(cell), F.lit(0.0))
        n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
        hits.append(hit.groupBy("id", (cell + 0.0).alias("cell")).agg(n.alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")))
    whole = hits[0]
    for hit in hits[1:]:
        whole = whole.unionByName(hit)
    return whole


def interpolated_percentiles(counts: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Percentiles by linear interpolation between the two ranks around q * (n - 1): keys, q, value. Exact, and like ``refine_ranks`` without a place that holds all values."""
    upper = 2.0  # marks the rank above
    rank = lambda q, n: F.when(q >= upper, F.floor((q - upper) * (n - 1)) + 2).otherwise(F.floor(q * (n - 1)) + 1)
    found = refine_ranks(counts, keys, [*quantiles, *[float(q) + upper for q in quantiles]], rank_of=rank)
    exact = F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("_i"))
    which = F.array_position(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("q"))
    which_upper = F.array_position(F.array(*[F.lit(float(q) + upper) for q in quantiles]), F.col("q"))
    sided = found.withColumn("_i", F.greatest(which, which_upper).cast("int")).withColumn("_up", which_upper > 0)
    pair = sided.groupBy(*keys, "_i", "n_rows").agg(F.max(F.when(~F.col("_up"), F.col("lo"))).alias("a"), F.max(F.when(F.col("_up"), F.col("lo"))).alias("b"))
    at = exact * (F.col("n_rows") - 1)
    return pair.select(*keys, exact.alias("q"), (F.col("a") + (at - F.floor(at)) * (F.col("b") - F.col("a"))).alias("value"))
