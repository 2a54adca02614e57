"""Many small delimited files into few well-sized ones that hold each distinct record once."""

from __future__ import annotations

import csv
import io
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.storage import _fs, delete_path, materialize, new_path, result_path

_PREFIX = re.compile(r"^﻿?\d+\t")


def parse_all(body: str | None, width: int, null_text: str = "NULL") -> Iterator[tuple[list[str | None] | None, str]]:
    """Every row of a headerless CSV text: (its fields, the empty text), or (None, the row as it stands) if it doesn't have exactly ``width`` fields or isn't CSV.

    A ``digits+TAB`` prefix of a record is dropped, line ends inside quoted
    fields become ``\\n``, NUL characters vanish, and empty cells and
    ``null_text`` give None. Empty lines are no rows.
    """
    if not body:
        return
    reader = csv.reader(io.StringIO(body.replace("\x00", ""), newline=""))
    while True:
        try:
            row = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            yield None, f"line {reader.line_num}: {e}"
            continue
        if not row:
            continue
        if len(row) != width:
            yield None, ",".join(row)
            continue
        if m := _PREFIX.match(row[0]):
            row[0] = row[0][m.end() :].strip('"')
        yield [None if x == null_text or x == "" else x.replace("\r\n", "\n").replace("\r", "\n") if "\r" in x else x for x in row], ""


def parse_rows(body: str | None, width: int, null_text: str = "NULL") -> Iterator[list[str | None]]:
    """The rows of ``parse_all`` that have all fields."""
    return (row for row, _ in parse_all(body, width, null_text) if row is not None)


def parse_files(files: DataFrame, file_id: Column, body: Column, fields: Sequence[str]) -> DataFrame:
    """Every row of every body: file_id, then ``fields`` as STRING, then rejected.

    ``rejected`` is null for a record; a row that is none has it as text there and no fields.
    Bodies that are null or empty give no rows; rows of a file without id have a null one.
    """
    names = list(fields)
    columns = ["file_id", *names, "rejected"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        none = [None] * len(names)
        for batch in batches:
            rows = []
            for i, text in zip(batch["f"], batch["b"]):
                rows += [(i, *(none if row is None else row), bad if row is None else None) for row, bad in parse_all(text, len(names))]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    # as text, since pandas has no integers with nulls
    parsed = files.select(file_id.cast("string").alias("f"), body.alias("b")).mapInPandas(parse, schema)
    return parsed.withColumn("file_id", F.col("file_id").cast("long"))


def read_small_files(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``parse_files`` of the files under ``paths`` (folders or globs, read whole, in UTF-8); file_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return parse_files(files, F.xxhash64("path"), F.decode("content", "UTF-8"), fields)


def record_key(fields: Sequence[str]) -> list[Column]:
    """Two independent 64-bit hashes of a record, null and text kept apart."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(f)), F.lit("-")) for f in fields]
    return [F.xxhash64(*marked).alias("r1"), F.xxhash64(F.lit("second"), *marked).alias("r2")]


@dataclass
class Consolidated:
    """records: the distinct records, as read from ``path``; holders: distinct (file_id, row), row numbering the records of ``path``; rejected: file_id and text of rows that are no records.

    n_rows = n_in + n_rejected rows were read, n_in = n_records + n_copies of them are records; n_files files hold the distinct ones.
    """

    path: str
    records: DataFrame
    holders: DataFrame
    rejected: DataFrame
    n_rows: int
    n_in: int
    n_rejected: int
    n_copies: int
    n_records: int
    n_files: int


def _checksum(df: DataFrame, fields: Sequence[str]) -> tuple[int, int, int]:
    row = df.select(*record_key(fields)).agg(F.count(F.lit(1)), F.bit_xor("r1"), F.bit_xor("r2")).first()
    return row[0], row[1] or 0, row[2] or 0


def swap_folder(spark: SparkSession, staging: str, path: str) -> None:
    """Put the folder ``staging`` in the place of ``path``. If a step fails, ``path`` is put back as it was and an error raised; nothing is deleted before the new folder is in its place."""
    fs, to = _fs(spark, path)
    source = _fs(spark, staging)[1]

    def moved(a, b) -> bool:
        try:
            return fs.rename(a, b)
        except Py4JJavaError:  # some file systems raise, others answer false
            return False

    old = None
    if fs.exists(to):
        old = _fs(spark, new_path(spark, "replaced"))[1]
        fs.mkdirs(old.getParent())
        if not moved(to, old):
            raise RuntimeError(f"{path} could not be moved aside")
    elif not fs.exists(to.getParent()):
        fs.mkdirs(to.getParent())
    if not moved(source, to):
        if old is not None and not moved(old, to):
            raise RuntimeError(f"{path} could not be replaced; its old content is at {old}")
        raise RuntimeError(f"{path} could not be replaced and is as it was")
    if old is not None:
        fs.delete(old, True)


def consolidate(parsed: DataFrame, fields: Sequence[str], path: str | None = None, cluster_by: Sequence[str] | None = None, target_bytes: int = 128 << 20) -> Consolidated:
    """Write the distinct records of ``parsed`` (``parse_files``: file_id, ``fields`` and, if there, rejected) to few large sorted files under ``path``.

    Copies are first dropped on the map side and by hash of the whole record,
    so that no key, however often repeated, gathers in one task. The distinct
    records are range-partitioned by ``cluster_by`` (all fields by default;
    ties are spread by the record's hash) with sampled boundaries into as many
    ranges as their bytes need at ``target_bytes``, sorted, and written to a
    staging folder. Count and checksum read back from there must equal those
    of the distinct input, and rows read must be records, copies and rejected
    rows together; only then does the staging folder take the place of
    ``path``. A failed reconciliation raises and leaves ``path`` as it was.
    Which file holds which record is found from what was written. Rejected rows are kept beside it in a table of their own.
    Null fields are values like any other; no records give an empty table.
    """
    fields = list(fields)
    spark: SparkSession = parsed.sparkSession
    path = path or result_path(spark, "consolidated")
    keys = list(cluster_by or fields)
    rejected = F.col("rejected") if "rejected" in parsed.columns else F.lit(None).cast("string")
    every = materialize(parsed.select("file_id", *fields, *record_key(fields), rejected.alias("rejected")), "parsed")
    read = every.where(F.col("rejected").isNull()).drop("rejected")
    distinct = materialize(read.select(*fields, "r1", "r2").dropDuplicates(["r1", "r2"]), "distinct")
    size = F.lit(0).cast("long")
    for f in fields:
        size += F.coalesce(F.octet_length(f), F.lit(1)) + 3
    rows = every.agg(F.count(F.lit(1)), F.count("rejected")).first()
    known = distinct.agg(F.count(F.lit(1)), F.sum(size), F.bit_xor("r1"), F.bit_xor("r2")).first()
    n_files = max(1, math.ceil((known[1] or 0) / target_bytes))
    staging = new_path(spark, "staging")
    ranged = distinct.repartitionByRange(n_files, *[F.col(k) for k in keys], F.col("r1")).sortWithinPartitions(*keys, "r1")
    ranged.select(*fields).write.parquet(staging)
    schema = ranged.select(*fields).schema
    back = _checksum(spark.read.schema(schema).parquet(staging), fields)
    n_in = rows[0] - rows[1]
    if back != (known[0], known[2] or 0, known[3] or 0) or n_in < known[0]:
        delete_path(spark, staging)
        raise RuntimeError(f"consolidation of {path}: {rows[0]} rows read, {rows[1]} rejected, {known[0]} distinct records, {back[0]} written, or their checksums differ")
    swap_folder(spark, staging, path)
    records = spark.read.schema(schema).parquet(path)
    numbered = materialize(records.select(*record_key(fields), F.monotonically_increasing_id().alias("row")), "numbered")
    holders = read.where(F.col("file_id").isNotNull()).select("file_id", "r1", "r2").distinct().join(numbered, ["r1", "r2"]).select("file_id", "row")
    return Consolidated(path, records, holders, every.where(F.col("rejected").isNotNull()).select("file_id", "rejected"), rows[0], n_in, rows[1], n_in - known[0], known[0], n_files)


def redundant_files(holders: DataFrame) -> DataFrame:
    """Files that add nothing: file_id, reason (``same`` or ``subset``).

    A file with at least one record is redundant if one other file holds all
    its records and either more distinct ones (subset), or the same ones under
    a smaller file_id (same). Equal sets are found by an order-free 128-bit
    fingerprint and reduced to their smallest file first. A set can only lie
    within larger sets that hold its rarest record, so only these are compared, and
    none if that record occurs in no larger set. Of these candidates those go on that hold the
    second rarest record too, then the third, and only what is left is compared whole;
    sets of up to three records are then settled. ``holders`` are distinct (file_id, row).
    """
    sets = holders.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), "row")).alias("x2"))
    by_set = sets.groupBy("n", "x1", "x2").agg(F.min("file_id").alias("rep"))
    sets = materialize(sets.join(by_set, ["n", "x1", "x2"]).select("file_id", "rep", "n"), "file-sets")
    same = sets.where("file_id <> rep").select("file_id", F.lit("same").alias("reason"))
    reps = sets.where("file_id = rep").select("file_id", "n")
    held = materialize(holders.join(reps, "file_id").select("file_id", "n", "row"), "held")
    spread = held.groupBy("row").agg(F.count(F.lit(1)).alias("df"), F.max("n").alias("largest"))
    s = F.struct("df", "row", "largest")
    third = held.join(spread, "row").select("file_id", "n", s.alias("s"))
    rarest = third.groupBy("file_id", "n").agg(F.min("s").alias("a"), F.min_by(F.col("s.row"), F.col("s")).alias("row1"))
    rarest = rarest.where((F.col("a.df") > 1) & (F.col("a.largest") > F.col("n"))).select("file_id", "n", "row1")
    rarest = materialize(rarest, "rarest")
    single = rarest.where("n = 1").select("file_id")
    more = third.join(rarest.where("n > 1"), ["file_id", "n"]).where(F.col("s.row") != F.col("row1"))
    second = more.groupBy("file_id", "n", "row1").agg(F.min("s").alias("b"))
    three = more.join(second, ["file_id", "n", "row1"]).groupBy("file_id", "n", "row1", F.col("b.row").alias("row2")).agg(F.min(F.when(F.col("s.row") != F.col("b.row"), F.col("s"))).alias("c"))
    three = materialize(three.select(F.col("file_id").alias("a"), F.col("n").alias("na"), "row1", "row2", F.col("c.row").alias("row3")), "three")
    pairs = three.join(held.select(F.col("file_id").alias("b"), F.col("n").alias("nb"), F.col("row").alias("row1")), "row1").where("nb > na").select("a", "b", "na", "row2", "row3")
    own = held.select(F.col("file_id").alias("b"), "row")
    pairs = pairs.join(own.withColumnRenamed("row", "row2"), ["b", "row2"], "left_semi")
    pairs = materialize(pairs.where("row3 is null").unionByName(pairs.where("row3 is not null").join(own.withColumnRenamed("row", "row3"), ["b", "row3"], "left_semi")).select("a", "b", "na"), "candidates")
    settled = pairs.where("na <= 3").select(F.col("a").alias("file_id"))
    of_a = pairs.where("na > 3").join(held.select(F.col("file_id").alias("a"), "row"), "a")
    shared = of_a.join(own, ["b", "row"]).groupBy("a", "b", "na").agg(F.count(F.lit(1)).alias("c"))
    within = shared.where("c = na").select(F.col("a").alias("file_id"))
    subset = single.unionByName(settled).unionByName(within).distinct().withColumn("reason", F.lit("subset"))
    return same.unionByName(subset)
