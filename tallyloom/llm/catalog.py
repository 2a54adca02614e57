"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C
from tallyloom.llm import catalog_sql, distinct, langid, leakage, packing, percentiles, terms, truncation
from tallyloom.plans.tables import clean_features, table
from tallyloom.storage import materialize

#: Ranks of the public tokenizer in which problem 8 measures texts; TALLYLOOM_RANKS_FILE names another file.
RANKS_FILE = os.environ.get("TALLYLOOM_RANKS_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def p1_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users for each load day, week, county and combination; distinct counties per day and per week."""
    f = clean_features(spark, folder)
    groups = {"load_day": F.col("load_day"), "yw": F.col("yw"), "cnty": F.col("cnty")}
    users = distinct.count_distinct(
        distinct.partial_pairs(f, F.col("userid"), groups),
        {"day": ["load_day"], "week": ["yw"], "county": ["cnty"], "day+week": ["load_day", "yw"], "day+county": ["load_day", "cnty"], "week+county": ["yw", "cnty"], "day+week+county": ["load_day", "yw", "cnty"]},
    )
    counties = distinct.count_distinct(distinct.partial_pairs(f, F.col("cnty"), {"load_day": F.col("load_day"), "yw": F.col("yw")}), {"day": ["load_day"], "week": ["yw"]})
    return users.select(F.lit("userid").alias("counted"), "level", "load_day", "yw", "cnty", "n_distinct").unionByName(
        counties.select(F.lit("cnty").alias("counted"), "level", "load_day", "yw", F.lit(None).cast("string").alias("cnty"), "n_distinct")
    )


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct term with its total feat_count, rows, user-weeks and mark."""
    f = clean_features(spark, folder)
    rows = terms.term_rows(f, F.col("term"), F.col("group_id"), F.col("feat_count"))
    n_records = rows.agg(F.count_distinct("record").alias("n")).scalar()
    return terms.mark_terms(terms.term_frequencies(rows), n_records).select(F.col("term").alias("feat"), "occurrences", F.round("total_weight", 6).alias("feat_count"), F.col("records").alias("user_weeks"), "mark")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_terms(spark, folder).where("mark is not null").select("feat", "mark")


def p2_message_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """All word n-grams of up to three words in the messages, with occurrences and messages."""
    m = table(spark, folder, "messages").groupBy("message_id").agg(F.min("message").alias("message"))
    words = F.regexp_extract_all(F.lower("message"), F.lit(r"[\p{L}\p{N}_']+"), 0)
    return terms.ngram_frequencies(m, F.col("message_id"), words, 3)


def _message_parts(spark: SparkSession, folder: str, with_text: bool = True) -> DataFrame:
    m = table(spark, folder, "messages")
    model = langid.fit_filter(m, F.col("message"), F.col("lang"))
    return langid.segment_languages(m.withColumnRenamed("lang", "label"), model, ["message_id", "label"], F.col("message"), with_text)


def p3_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every message with its language and confidence."""
    return _message_parts(spark, folder).distinct()


def p3_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One row a message, also of those without a word: its main language, confidence and all languages."""
    found = langid.main_language(_message_parts(spark, folder, False).distinct(), ["message_id"])
    every = table(spark, folder, "messages").select("message_id").where(F.col("message_id").isNotNull()).distinct()
    return every.join(found, "message_id", "left").select("message_id", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "languages", F.coalesce("n_languages", F.lit(0)).alias("n_languages"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.unlabelled_languages(_message_parts(spark, folder, False), "message_id", F.col("label"))


def _percentiles(spark: SparkSession, folder: str, levels: dict) -> DataFrame:
    f = clean_features(spark, folder)
    found = percentiles.bisect_percentiles(percentiles.group_rows(f, levels, F.col("feat_freq"), C.plausible_share(F.col("feat_freq"))), PERCENTILES)
    return found.select("level", "yw", "cnty", "term", "percentile", "n_rows", F.col("lo").alias("value"))


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and other percentiles of the valid feat_freq of every week, every county and every term."""
    return _percentiles(spark, folder, {"week": {"yw": F.col("yw")}, "county": {"cnty": F.col("cnty")}, "term": {"term": F.col("term")}})


def p4_percentiles_of_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every combination of week, county and term."""
    return _percentiles(spark, folder, {"week+county+term": {"yw": F.col("yw"), "cnty": F.col("cnty"), "term": F.col("term")}})


def p9_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold evaluation items, and those that hold an item's template with other names and numbers (``variant``)."""
    d, e = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return leakage.find_leaks(d, F.col("doc_id"), F.col("text"), e, F.col("item_id"), F.col("text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    d, e = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    found = leakage.find_leaks(d, F.col("doc_id"), F.col("text"), e, F.col("item_id"), F.col("text"), variants=False)
    return found.select("doc_id", "item_id")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its container, for each capacity."""
    sizes = materialize(packing.token_counts(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), RANKS_FILE), "sizes")
    return packing.pack_documents(sizes, table(spark, folder, "pack_targets"))


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether p8_packing keeps its promises, counted per target."""
    d, targets = table(spark, folder, "documents"), table(spark, folder, "pack_targets")
    sizes = materialize(packing.token_counts(d, F.col("doc_id"), F.col("text"), RANKS_FILE), "sizes")
    return packing.check_packing(packing.pack_documents(sizes, targets), sizes, targets)


def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_summary(p8_packing(spark, folder), table(spark, folder, "pack_targets"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.judge_texts(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), F.col("source"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).where("cut").select("doc_id").distinct()


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The share of cut texts per source."""
    return truncation.cut_shares(_judged(spark, folder))


def queries() -> dict:
    return {
        "p1_distinct": p1_distinct,
        "p2_found": p2_found,
        "p2_terms": p2_terms,
        "p2_message_ngrams": p2_message_ngrams,
        "p3_found": p3_found,
        "p3_parts": p3_parts,
        "p3_messages": p3_messages,
        "p10_found": p10_found,
        "p10_sources": p10_sources,
        "p8_packing": p8_packing,
        "p8_summary": p8_summary,
        "p8_check": p8_check,
        "p9_found": p9_found,
        "p9_matches": p9_matches,
        "p4_percentiles": p4_percentiles,
        "p4_percentiles_of_cells": p4_percentiles_of_cells,
    }


def oracle_sql() -> dict[str, str]:
    return dict(catalog_sql.ORACLES)
