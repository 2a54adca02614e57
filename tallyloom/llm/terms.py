"""Frequencies of all n-grams from a distributed suffix array with common-prefix intervals.

Suffixes (cut to the longest n-gram asked for) are brought into one global
order by range partitioning. The common prefix of each with its neighbour is
found once; the runs over which it doesn't fall below n are the intervals of
depth n, each of them one n-gram, and the length of an interval is the
n-gram's number of occurrences. A record that holds it several times shows as
suffixes of that record with a common prefix of at least n tokens; taking
those adjacencies off leaves the number of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import materialize

#: Joins the tokens of a suffix; sorts below every character a token may hold.
SEP = "\x01"


def suffixes(df: DataFrame, record: Column, tokens: Column, max_n: int) -> DataFrame:
    """Every suffix of every record's token array, cut to max_n tokens: suffix, record, weight (1.0), dup.

    ``dup`` is the length of the prefix in tokens that the suffix shares with
    its predecessor among the sorted suffixes of the same record (its
    within-record adjacency). Null records and null or empty token arrays give
    none; null or empty tokens are dropped. Whole records are used; a record's suffixes are sorted within its own row.
    """
    clean = F.filter(tokens, lambda t: t.isNotNull() & (t != ""))
    rows = df.select(record.alias("record"), clean.alias("_t")).where(F.col("record").isNotNull() & (F.size("_t") > 0))
    cut = F.transform(F.sequence(F.lit(1), F.size("_t")), lambda i: F.array_join(F.slice("_t", i, max_n), SEP))
    ordered = rows.select("record", F.array_sort(cut).alias("_s"))
    paired = F.arrays_zip(F.col("_s").alias("suffix"), F.concat(F.array(F.lit("")), F.slice("_s", 1, F.size("_s") - 1)).alias("before"))
    each = ordered.select("record", F.inline(paired))
    a, b = F.split("suffix", SEP), F.split("before", SEP)
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.coalesce(z["x"] == z["y"], F.lit(False)))
    first_difference = F.array_position(same, False)
    dup = F.when(F.col("before") == "", 0).otherwise(F.when(first_difference == 0, F.size(same)).otherwise(first_difference - 1))
    return each.select("suffix", "record", F.lit(1.0).alias("weight"), dup.cast("int").alias("dup"))


def lcp_intervals(ordered: DataFrame, max_n: int) -> DataFrame:
    """Intervals of a suffix array in its order (suffix, record, weight, and dup if known): ngram, n, occurrences, weight, duplicates, and edges.

    In every partition the common prefix (in tokens) of each suffix with the
    one before is found; where it falls below n, a new interval of depth n
    starts, and the suffixes in it share one n-gram. ``duplicates`` are those
    whose record holds the n-gram before: by ``dup`` or, without it, where the
    neighbour is of the same record (for suffixes of one token, ordered by record within).
    Intervals that a batch or a partition's boundary cuts come in parts that add up. So that neighbours across
    partitions can be compared, each partition's first and last suffix come once more with n = 0, with record, part and side (0 first, 1 last).
    """
    known = "dup" in ordered.columns
    schema = "ngram string, n int, occurrences long, weight double, duplicates long, record string, part int, side int"
    out = pa.schema([("ngram", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("weight", pa.float64()), ("duplicates", pa.int64()), ("record", pa.string()), ("part", pa.int32()), ("side", pa.int32())])

    def edge(suffix: str, record: str, part: int, side: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([suffix], [0], [0], [0.0], [0], [record], [part], [side]), out)], schema=out)

    def columns(text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The tokens by place, and how many each suffix has."""
        if max_n == 1:
            return [text], np.ones(len(text), np.int64)
        tokens = [t.split(SEP) for t in text]
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return [np.array([t[k] if k < len(t) else None for t in tokens], dtype=object) for k in range(max_n)], size

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple | None = None  # tokens, suffix and record of the suffix before the batch
        for batch in batches:
            if not batch.num_rows:
                continue
            text, record, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            tokens, size = columns(text)
            lcp = np.zeros(len(text), np.int64)
            same = np.ones(len(text), bool)
            for k, token in enumerate(tokens):
                before = np.concatenate([[last[0][k] if last else None], token[:-1]])
                same &= (token == before) & (size > k)
                lcp += same
            if known:
                dup = batch.column(3).to_numpy(zero_copy_only=False)
            else:
                dup = np.where(record == np.concatenate([[last[2] if last else None], record[:-1]]), lcp, 0)
            if last is None and not known:
                yield edge(text[0], record[0], part, 0)
            last = [token[-1] for token in tokens], text[-1], record[-1]
            for n in range(1, max_n + 1):
                rows = np.flatnonzero(size >= n)
                if not len(rows):
                    continue
                new = lcp[rows] < n
                new[0] = True
                start = np.flatnonzero(new)
                at = rows[start]
                gram = text[at] if max_n == 1 else [SEP.join(t) for t in zip(*(token[at] for token in tokens[:n]))]
                none = np.full(len(start), None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram, pa.string()),
                        pa.array(np.full(len(start), n, np.int32)),
                        pa.array(np.diff(np.r_[start, len(rows)]).astype(np.int64)),
                        pa.array(np.add.reduceat(weight[rows], start)),
                        pa.array(np.add.reduceat((dup[rows] >= n).astype(np.int64), start)),
                        pa.array(none, pa.string()),
                        pa.array(none, pa.int32()),
                        pa.array(none, pa.int32()),
                    ],
                    schema=out,
                )
        if last is not None and not known:
            yield edge(last[1], last[2], part, 1)

    return ordered.select("suffix", "record", "weight", *(["dup"] if known else [])).mapInArrow(intervals, schema)


def interval_sums(intervals: DataFrame) -> DataFrame:
    """Parts of ``lcp_intervals`` added up: ngram, n, occurrences, weight, records.

    The records of an n-gram are its occurrences less its duplicates, and less those that meet their neighbour across a partition's boundary.
    """
    # edges go with their whole suffix, which is the 1-gram itself; an n-gram has at most two a partition
    n = F.greatest("n", F.lit(1))
    edges = F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.struct("part", "side", "record"))))
    sums = intervals.groupBy("ngram", n.alias("n")).agg(F.sum("occurrences").alias("occurrences"), F.sum("weight").alias("weight"), F.sum("duplicates").alias("_d"), edges.alias("_e"))
    pairs = F.when(F.size("_e") > 1, F.sequence(F.lit(2), F.size("_e"))).otherwise(F.array().cast("array<int>"))
    before, here = lambda i: F.element_at("_e", i - 1), lambda i: F.element_at("_e", i)
    across = F.size(F.filter(pairs, lambda i: (before(i)["side"] == 1) & (here(i)["side"] == 0) & (before(i)["record"] == here(i)["record"])))
    return sums.select("ngram", "n", "occurrences", "weight", (F.col("occurrences") - F.col("_d") - across).alias("records"))


def ngram_frequencies(df: DataFrame, record: Column, tokens: Column, max_n: int = 1) -> DataFrame:
    """All n-grams up to max_n tokens: ngram (joined by one space), n, occurrences, records."""
    ordered = suffixes(df, record, tokens, max_n).withColumn("record", F.col("record").cast("string"))
    # the hash of the record spreads a suffix that holds a large part of all rows over several ranges
    ordered = ordered.repartitionByRange(F.col("suffix"), F.xxhash64("record")).sortWithinPartitions("suffix")
    return interval_sums(lcp_intervals(ordered, max_n)).select(F.translate("ngram", SEP, " ").alias("ngram"), "n", "occurrences", "records")


def term_rows(df: DataFrame, term: Column, record: Column, weight: Column) -> DataFrame:
    """The suffixes of a table with one row per record and term, written once: suffix (the term), record, weight. Null and NaN weights are 0; rows without record are dropped, those without term only count as records."""
    w = F.coalesce(F.nanvl(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    return materialize(df.select(term.alias("suffix"), record.cast("string").alias("record"), w.alias("weight")).where(F.col("record").isNotNull()), "terms")


def term_frequencies(rows: DataFrame) -> DataFrame:
    """Every distinct term of ``term_rows``: term, occurrences, total_weight, records.

    The suffix array of texts of one term each. Its order is (term, record,
    row), so a record's repeated rows of a term are adjacent, and each such
    adjacency takes one off its records. Copies of one (term, record) may hold any share
    of all rows: the order by row spreads them over ranges.
    """
    known = rows.where(F.col("suffix").isNotNull())
    ordered = known.withColumn("_i", F.monotonically_increasing_id()).repartitionByRange("suffix", "record", "_i").sortWithinPartitions("suffix", "record")
    return interval_sums(lcp_intervals(ordered, 1)).select(F.col("ngram").alias("term"), "occurrences", F.col("weight").alias("total_weight"), "records")


def mark_terms(frequencies: DataFrame, n_records: Column, least_records: int = 3, common_share: float = 0.05) -> DataFrame:
    """Adds mark: ``rare`` under least_records records, ``common`` above that share of n_records, else null."""
    rare = F.col("records") < least_records
    common = F.col("records") > common_share * n_records
    return frequencies.withColumn("mark", F.when(rare, "rare").when(common, "common"))
