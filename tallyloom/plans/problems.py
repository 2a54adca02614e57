"""Queries of the general data problems (implausible readings, hot keys, small files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import compaction, hotkeys, spikes
from tallyloom.plans.tables import clean_features, table

#: The six fields of a message record.
MESSAGE_FIELDS = ["message_id", "user_id", "message", "created_at", "date2", "date3"]


def p5_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every implausible reading with its reasons and the fence it was compared with."""
    f = clean_features(spark, folder)
    week = F.translate("week_of_group", "_", "").cast("int")
    return spikes.flag_readings(f, F.col("row_id"), F.col("user_of_group"), F.col("term"), week, F.col("feat_freq"), context=F.col("load_hour"))


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p5_found with their reasons, from those of p5_flags.

    Of the readings outside their fence, those count as spikes that reach the
    user's ``jump``: a fence of two interquartile ranges takes in less than a spike needs, three times every ordinary reading.
    A steep change alone is none of its reasons: ordinary shares of a term rise and fall so, too.
    """
    spike = F.col("outside") & F.coalesce(F.col("reading") >= F.col("jump"), F.lit(False))
    return p5_flags(spark, folder).select("row_id", "impossible", "stuck", spike.alias("spike")).where("impossible or stuck or spike")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_reasons(spark, folder).select("row_id")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, users, mean and quartiles of feat_freq for every county and every term."""
    f = clean_features(spark, folder)
    report = hotkeys.key_report(f, {"cnty": F.col("cnty"), "feat": F.col("term")}, F.col("feat_freq"), F.col("userid"), (0.25, 0.5, 0.75))
    return report.withColumns({c: F.round(c, 9) for c in ("mean_value", "share")})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The hot values, from the operator's mergeable histograms; their members and quantiles are in p6_report."""
    f = clean_features(spark, folder)
    return hotkeys.hot_keys(f, {"cnty": F.col("cnty"), "feat": F.col("term")}, F.col("feat_freq")).where("hot").select("field_name", "key_value")


def _consolidated(spark: SparkSession, folder: str) -> compaction.Consolidated:
    parsed = compaction.parse_files(table(spark, folder, "message_files"), F.col("file_id"), F.col("body"), MESSAGE_FIELDS)
    return compaction.consolidate(parsed, MESSAGE_FIELDS, cluster_by=["created_at", "message_id"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.redundant_files(_consolidated(spark, folder).holders).select("file_id")


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct message record once, read back from the consolidated files."""
    return _consolidated(spark, folder).records


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The reconciled counts of the consolidation: rows read, rejected rows, records, copies and distinct records."""
    c = _consolidated(spark, folder)
    return spark.createDataFrame([(c.n_rows, c.n_rejected, c.n_in, c.n_copies, c.n_records)], "n_rows long, n_rejected long, n_in long, n_copies long, n_records long")


def queries() -> dict:
    return {"p5_found": p5_found, "p5_flags": p5_flags, "p5_reasons": p5_reasons, "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_records": p7_records, "p7_counts": p7_counts}
