"""The tables of a data folder, and the cleaned view of the feature table that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_features(spark: SparkSession, folder: str) -> DataFrame:
    """feat_1gram with cleaned keys: row_id, group_id, week_of_group, user_of_group, term, yw, cnty, userid, feat_count, feat_freq, weight, load_day, load_hour."""
    df = table(spark, folder, "feat_1gram")
    # in steps, each value named once: an expression used by several others is then evaluated once a row
    df = df.select(
        "row_id",
        F.trim(F.translate("yearweek_userid", '"', "")).alias("_g"),
        C.clean_text_value(F.col("feat")).alias("term"),
        C.clean_text_value(F.col("yw")).alias("_w"),
        C.clean_text_value(F.col("cnty")).alias("_c"),
        C.clean_text_value(F.col("userid")).alias("userid"),
        "feat_count",
        "feat_freq",
        F.coalesce("ywui_wt", F.lit(1.0)).alias("weight"),
        F.to_date("loaded_at").alias("load_day"),
        F.hour("loaded_at").alias("load_hour"),
    )
    rest = ["userid", "feat_count", "feat_freq", "weight", "load_day", "load_hour"]
    df = df.select("row_id", C.blank_to_null(C.pad_week(F.col("_g"))).alias("group_id"), "term", C.pad_week(F.col("_w")).alias("yw"), C.pad_county(F.col("_c")).alias("cnty"), *rest)
    gid = F.col("group_id")
    return df.select("row_id", "group_id", C.group_week(gid).alias("week_of_group"), C.group_entity(gid).alias("user_of_group"), "term", "yw", "cnty", *rest)
