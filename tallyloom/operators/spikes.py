"""Implausible readings of a measurement, judged by what the same source otherwise shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import finite, plausible_share
from tallyloom.storage import join_checked, materialize

#: Buckets of the sketch per doubling of the reading.
PER_OCTAVE = 4


def source_sketch(df: DataFrame, source: str, reading: str, context: str | None = None) -> DataFrame:
    """A quantile sketch per source (and context): source, [context], bucket, n, mn, mx.

    Buckets are logarithmic, ``PER_OCTAVE`` to a doubling, so a source has at
    most a few hundred of them whatever its rows, and a quantile read from a
    bucket is off by less than 19 %. Every bucket keeps its exact count, least
    and greatest reading. Only readings above 0 and at most 1 enter.
    """
    keys = [source] + ([context] if context else [])
    bucket = F.floor(F.log2(F.col(reading)) * PER_OCTAVE).cast("int")
    valid = df.where(F.col(source).isNotNull() & plausible_share(F.col(reading)))
    return valid.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(reading).alias("mn"), F.max(reading).alias("mx"))


def merge_sketches(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of partitions, days or contexts put together, to the given keys."""
    return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def jumps(sketch: DataFrame, keys: list[str], ratio: float = 3.0, min_readings: int = 30) -> DataFrame:
    """Per key: jump, the least reading beyond an implausible rise over all ordinary ones; keys without one are absent.

    Exact: readings in ascending order rise by less than a doubling within a bucket,
    so every rise by ``ratio`` (which must be at least 2) lies between the
    greatest reading of a bucket and the least of the next; the lowest such
    rise counts that has at least half of the readings below it. Keys with
    fewer than ``min_readings`` readings have none. Windows run over the few buckets of a key.
    """
    by = Window.partitionBy(*keys).orderBy("bucket")
    upto = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = sketch.withColumn("upto", upto).withColumn("before", F.lag("mx").over(by)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    below = F.col("upto") - F.col("n")
    rise = (F.col("mn") >= ratio * F.col("before")) & (below * 2 >= F.col("total")) & (F.col("total") >= min_readings)
    return rows.where(rise).groupBy(*keys).agg(F.min("mn").alias("jump"))


def fences(sketch: DataFrame, source: str, context: str | None, expand: float = 2.0, ratio: float = 3.0, min_readings: int = 30) -> DataFrame:
    """Interquartile fences of every source and each of its contexts: source, low, high, by_context (map of context to low and high), jump.

    Quartiles are read from the merged buckets of the ordinary readings (those
    below the source's ``jump``; q1 as its bucket's least, q3 as its bucket's greatest reading), so that spikes, however many, don't move
    their own fence. high is q3 + expand * (q3 - q1), low is q1 - expand * (q3 - q1). A context
    with fewer than ``min_readings`` ordinary readings has no fence of its own and takes the source's;
    sources with fewer have none (null). As q3 is itself an ordinary reading, with
    expand <= ratio - 1 every reading at or above ``jump`` lies outside every fence.
    Contexts are few (hours of a day), so a source's map is of bounded size.
    """
    inner = [source] + ([context] if context else [])
    whole = merge_sketches(sketch, [source]) if context else sketch
    jump = jumps(whole, [source], ratio, min_readings)
    known = sketch.join(jump, source, "left").where(F.col("jump").isNull() | (F.col("mn") < F.col("jump")))

    def quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys)
        ranked = rows.withColumn("_upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(by))
        at = lambda q, end: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col(end)))
        got = ranked.where(F.col("_all") >= min_readings).groupBy(*keys).agg(at(0.25, "mn").alias("q1"), at(0.75, "mx").alias("q3"))
        width = expand * (F.col("q3") - F.col("q1"))
        return got.select(*keys, (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))

    out = quartiles(merge_sketches(known, [source]), [source])
    if context:
        own = quartiles(known, inner).groupBy(source).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col(context).cast("string"), F.lit("")), F.struct("low", "high")))).alias("by_context"))
        out = out.join(own, source, "left")
    else:
        out = out.withColumn("by_context", F.lit(None).cast("map<string,struct<low:double,high:double>>"))
    return out.join(jump, source, "left")


def changing_pairs(df: DataFrame, source: str, item: str, when: str, reading: str, least: int = 4, ratio: float = 3.0) -> DataFrame:
    """Rows of the (source, item) pairs that may have a run or a steep change: over more than one step, ``least`` rows or a greatest plausible reading of ``ratio`` times the least.

    No other pair can have one (``stuck_runs``, ``steep_steps``). Rows without source, item, step or finite reading are left out before the shuffle.
    """
    pair = Window.partitionBy(source, item)
    rows = df.where(F.col(source).isNotNull() & F.col(item).isNotNull() & F.col(when).isNotNull() & finite(F.col(reading)))
    valid = F.when(plausible_share(F.col(reading)), F.col(reading))
    sums = {"_n": F.count(F.lit(1)), "_lo": F.min(valid), "_hi": F.max(valid), "_a": F.min(when), "_b": F.max(when)}
    known = rows.withColumns({name: c.over(pair) for name, c in sums.items()})
    return known.where((F.col("_a") < F.col("_b")) & ((F.col("_n") >= least) | (F.col("_hi") >= ratio * F.col("_lo")))).drop(*sums)


def steep_steps(df: DataFrame, source: str, item: str, when: str, reading: str, ratio: float = 3.0) -> DataFrame:
    """Readings whose rate of change is implausible: source, item, when, reading, change.

    A reading is one if it is at least ``ratio`` times the greatest, or at most that part of the least, plausible reading
    that its (source, item) pair had at its step before, of whatever size both are; change is its quotient by that one.
    The steps of a pair are those values of ``when`` at which it has a plausible reading; its first step has no change.
    """
    keys = [source, item]
    rows = df.where(F.col(item).isNotNull() & F.col(when).isNotNull() & F.col(source).isNotNull() & plausible_share(F.col(reading))).select(*keys, when, reading)
    pair = Window.partitionBy(*keys)
    # the pairs' shuffle serves the distinct rows and both windows
    steps = rows.repartition(*keys).distinct().withColumn("_i", F.dense_rank().over(pair.orderBy(when)))
    before = pair.orderBy("_i").rangeBetween(-1, -1)
    known = steps.withColumns({"_least": F.min(reading).over(before), "_most": F.max(reading).over(before)})
    rise, fall = F.col(reading) >= ratio * F.col("_most"), F.col(reading) * ratio <= F.col("_least")
    return known.where(rise | fall).select(*keys, when, reading, (F.col(reading) / F.when(rise, F.col("_most")).otherwise(F.col("_least"))).alias("change"))


def stuck_runs(df: DataFrame, source: str, item: str, when: str, reading: str, least: int = 4) -> DataFrame:
    """Readings that stay exactly the same: source, item, when, reading of every step of a run.

    The steps of a (source, item) pair are those values of ``when`` at which it
    has a finite reading; a run is one reading shown at ``least`` or more
    successive steps. Repeated rows of a step count once. Rows without source,
    item, step or finite reading are passed over.

    The first pass keeps the readings with at least ``least`` rows over more
    than one step (nearly all others end there); only the pairs that have one
    are put in order, over their distinct steps.
    """
    keys = [source, item]
    rows = df.where(F.col(source).isNotNull() & F.col(item).isNotNull() & F.col(when).isNotNull() & finite(F.col(reading))).select(*keys, when, reading)
    seen = rows.groupBy(*keys, reading).agg(F.count(F.lit(1)).alias("n"), F.min(when).alias("a"), F.max(when).alias("b"))
    pairs = materialize(seen.where((F.col("n") >= least) & (F.col("a") < F.col("b"))).select(*keys).distinct(), "stuck-pairs")
    open_steps = join_checked(rows, pairs, keys, "left_semi").distinct()
    order = Window.partitionBy(*keys).orderBy(when)
    ranked = open_steps.withColumn("_i", F.dense_rank().over(order))
    same = ranked.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, reading).orderBy(when)))
    long = same.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, reading, "_run")))
    return long.where(F.col("_len") >= least).select(*keys, when, reading)


def flag_readings(
    df: DataFrame,
    row_id: Column,
    source: Column,
    item: Column,
    when: Column,
    reading: Column,
    context: Column | None = None,
    least: int = 4,
    ratio: float = 3.0,
    min_readings: int = 30,
) -> DataFrame:
    """Rows with an implausible reading: row_id, source, context, reading, impossible, stuck, outside, steep, low, high, jump.

    impossible: a reading that is NaN, infinite, not above 0 or above 1 (null is no reading).
    stuck: part of a run of the same value (``stuck_runs``); zero variance over ``least`` steps.
    outside: a plausible reading above or below the expanded interquartile
    fence of its source in its context (``fences``), or of the source where the context has too few readings.
    steep: a plausible reading, inside its fence or not, whose rate of change from the pair's step before is implausible (``steep_steps``).
    low, high, jump: the fence that was compared, and the source's least reading beyond a rise of ``ratio`` over all ordinary ones.

    Sketches are made per source and ``context`` (for example the hour of
    loading) in every partition and merged. Rows without source can only be impossible. Repeated
    rows are flagged each. Any column may be null (a null context is a context); an empty table gives an
    empty result; other columns of df, whatever their names, don't matter.
    """
    base = df.select(  # written once: each of the passes then reads only the cleaned columns it needs
        row_id.alias("row_id"), source.alias("source"), item.alias("item"), when.alias("step"), reading.cast("double").alias("reading"), (F.lit(None).cast("int") if context is None else context).alias("context")
    )
    base = materialize(base, "readings")
    sketch = materialize(source_sketch(base, "source", "reading", None if context is None else "context"), "sketch")
    bounds = materialize(fences(sketch, "source", None if context is None else "context", ratio - 1, ratio, min_readings), "fences")
    cell = ["source", "item", "step", "reading"]
    changing = materialize(changing_pairs(base, *cell, least, ratio), "changing")
    stuck = stuck_runs(changing, *cell, least).select(*cell, F.lit(True).alias("stuck"), F.lit(False).alias("steep"))
    steep = steep_steps(changing, *cell, ratio).select(*cell, F.lit(False).alias("stuck"), F.lit(True).alias("steep"))
    marks = materialize(stuck.unionByName(steep).groupBy(*cell).agg(F.max("stuck").alias("stuck"), F.max("steep").alias("steep")), "marks")
    plausible = plausible_share(F.col("reading"))
    own = F.try_element_at("by_context", F.coalesce(F.col("context").cast("string"), F.lit("")))

    def judged(rows: DataFrame) -> DataFrame:
        placed = join_checked(rows, bounds, ["source"], "left").withColumns({"low": F.coalesce(own["low"], F.col("low")), "high": F.coalesce(own["high"], F.col("high"))}).drop("by_context")
        outside = plausible & ((F.col("reading") > F.col("high")) | (F.col("reading") < F.col("low")))
        return placed.withColumns({"impossible": F.col("reading").isNotNull() & ~plausible, "outside": F.coalesce(outside, F.lit(False))})

    # all rows meet the fences, but only those of changing pairs the marks
    flagged = judged(base).where("impossible or outside").unionByName(judged(join_checked(changing, marks, cell, "left_semi")).where("not (impossible or outside)"))
    flagged = join_checked(flagged, marks, cell, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("stuck", "steep")})
    return flagged.select("row_id", "source", "context", "reading", "impossible", "stuck", "outside", "steep", "low", "high", "jump")
