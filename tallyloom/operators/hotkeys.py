"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import plausible_share
from tallyloom.operators.selection import refine_ranks, value_sketch
from tallyloom.storage import materialize

KEYS = ["field_name", "key_value"]


def unfold_keys(df: DataFrame, fields: Mapping[str, Column], value: Column, member: Column, valid: Column | None = None) -> DataFrame:
    """One row for each row and field whose key isn't null: field_name, key_value, v (the value; null where it isn't valid), member."""
    ok = plausible_share(value) if valid is None else valid
    picked = df.select(
        F.when(ok, value).alias("_v"), member.alias("_m"), F.array(*[F.struct(F.lit(name).alias("field_name"), key.alias("key_value")) for name, key in fields.items()]).alias("_keys")
    )
    return picked.select(F.inline("_keys"), F.col("_v").alias("v"), F.col("_m").alias("member")).where(F.col("key_value").isNotNull())


def key_counts(sketch: DataFrame, n_all: int, hot_share: float = 0.02) -> DataFrame:
    """Counts from the ``value_sketch`` of ``unfold_keys``: field_name, key_value, n_rows, n_valid, mean_value, share (of ``n_all`` rows), hot (share above ``hot_share``).

    A sketch has a few hundred cells a key at most, so this adds few rows however hot a key is. Sketches of loads may be merged before.
    """
    sums = sketch.groupBy(*KEYS).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("cell").isNotNull(), F.col("n"))), F.lit(0)).alias("n_valid"), F.sum("total").alias("_s"))
    share = F.col("n_rows") / F.lit(n_all)
    return sums.select(*KEYS, "n_rows", "n_valid", (F.col("_s") / F.nullif(F.col("n_valid"), F.lit(0))).alias("mean_value"), share.alias("share"), (share > hot_share).alias("hot"))


def hot_keys(df: DataFrame, fields: Mapping[str, Column], value: Column, hot_share: float = 0.02, valid: Column | None = None) -> DataFrame:
    """The first pass of ``key_report`` alone: ``key_counts`` from mergeable value histograms, without members and quantiles."""
    return key_counts(value_sketch(unfold_keys(df, fields, value, F.lit(None), valid), KEYS), df.count(), hot_share)


def key_report(
    df: DataFrame,
    fields: Mapping[str, Column],
    value: Column,
    member: Column,
    quantiles: Sequence[float] = (0.5,),
    hot_share: float = 0.02,
    valid: Column | None = None,
) -> DataFrame:
    """Rows, members, mean, quantiles and share of every key of every field, without a task that carries a hot key.

    Rows are counted into a value histogram per key on the map side
    (``value_sketch``), so a key with a third of all rows sends no more than
    its few hundred cells from each task. Counts, means and the hot mark are
    sums over the histogram; quantiles are selected exactly by refining it
    (``refine_ranks``). Members are made distinct per (field, key, member) and then counted.

    Columns: field_name, key_value, n_rows (rows with that key), n_members
    (distinct non-null members), n_valid, mean_value, one ``q<percent>`` a quantile (of valid values;
    null if there are none), share (of all rows of df), hot (share above
    ``hot_share``). Rows whose key is null are in no key, but count in the
    total. Repeated rows count each. An empty table gives an empty result. Other columns of df don't matter.
    """
    # written once: every pass then reads only these columns
    named = {f"_f{i}": key for i, key in enumerate(fields.values())}
    ok = plausible_share(value) if valid is None else valid
    base = materialize(df.select(F.when(ok, value).alias("_value"), member.alias("_member"), *[k.alias(n) for n, k in named.items()]), "keyed")
    long = unfold_keys(base, {name: F.col(f"_f{i}") for i, name in enumerate(fields)}, F.col("_value"), F.col("_member"), F.lit(True))
    sketch = materialize(value_sketch(long, KEYS), "histogram")
    members = long.where(F.col("member").isNotNull()).select(*KEYS, "member").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_members"))
    report = key_counts(sketch, base.count(), hot_share).join(members, KEYS, "left")
    if quantiles:
        ranks = refine_ranks(long, KEYS, quantiles, sketch=sketch)
        wide = ranks.groupBy(*KEYS).agg(*[F.max(F.when(F.col("q") == float(q), F.col("lo"))).alias(f"q{q * 100:g}") for q in quantiles])
        report = report.join(wide, KEYS, "left")
    return report.select(*KEYS, "n_rows", F.coalesce("n_members", F.lit(0)).alias("n_members"), "n_valid", "mean_value", *[f"`q{q * 100:g}`" for q in quantiles], "share", "hot")
