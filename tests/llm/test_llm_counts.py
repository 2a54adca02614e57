"""Distinct counts, n-gram frequencies and percentiles against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import distinct, percentiles, terms

LEVELS = {"day": ["d"], "county": ["c"], "day+county": ["d", "c"], "all": []}


def brute(data):
    out = defaultdict(set)
    for i, d, c in data:
        if i is not None:
            for level, own in LEVELS.items():
                out[level, d if "d" in own else None, c if "c" in own else None].add(i)
    return {k: len(v) for k, v in out.items()}


def counted(pairs):
    return {(r.level, r.d, r.c): r.n_distinct for r in distinct.count_distinct(pairs, LEVELS).collect()}


def test_distinct_counts(spark):
    rng = np.random.default_rng(1)
    data = [(None if rng.random() < 0.1 else f"u{rng.integers(80)}" if rng.random() < 0.6 else "hot", int(rng.integers(4)), f"c{rng.integers(5)}" if rng.random() < 0.9 else None) for _ in range(800)]
    df = spark.createDataFrame(data, "i string, d int, c string").withColumns({"bucket": F.lit("clash"), "level": F.lit(0)})
    groups = {"d": F.col("d"), "c": F.col("c")}
    assert counted(distinct.partial_pairs(df, F.col("i"), groups, 8)) == brute(data)
    parts = [distinct.partial_pairs(df.where(F.col("d") == k), F.col("i"), groups, 8) for k in range(4)]
    assert counted(distinct.merge_pairs([*parts, parts[0]])) == brute(data)
    assert counted(distinct.partial_pairs(df.limit(0), F.col("i"), groups)) == {}
    mixed = [distinct.partial_pairs(df.where(F.col("d") == k), F.col("i"), groups, 4 << k) for k in range(4)]
    merged = distinct.merge_pairs(mixed)
    assert counted(merged) == brute(data) and {r[0] for r in merged.select("buckets").distinct().collect()} == {4} and merged.agg(F.max("bucket")).first()[0] < 4
    assert [distinct.buckets_for(n) for n in (0, 10**6, 10**9, 10**13)] == [256, 256, 512, 8388608]


def test_buckets_shuffle_pairs_once(spark):
    df = spark.range(100).selectExpr("cast(id as string) i", "id % 3 d", "cast(id % 4 as string) c")
    plan = distinct.count_distinct(distinct.partial_pairs(df, F.col("i"), {"d": F.col("d"), "c": F.col("c")}), LEVELS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # distinct pairs, buckets, counts


def brute_ngrams(data, max_n):
    occ, rec = Counter(), defaultdict(set)
    for r, toks in data:
        if r is None or toks is None:
            continue
        toks = [t for t in toks if t]
        for n in range(1, max_n + 1):
            for i in range(len(toks) - n + 1):
                g = (" ".join(toks[i : i + n]), n)
                occ[g] += 1
                rec[g].add(r)
    return {g: (occ[g], len(rec[g])) for g in occ}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "", None, "é"]), max_size=12), max_size=25), st.integers(1, 4))
def test_ngrams_equal_brute_force(spark, lists, n):
    data = [(i, t) for i, t in enumerate(lists)] + [(None, ["a"]), (99, None)]
    df = spark.createDataFrame(data, "r long, t array<string>")
    got = {(r.ngram, r.n): (r.occurrences, r.records) for r in terms.ngram_frequencies(df, F.col("r"), F.col("t"), n).collect()}
    assert got == brute_ngrams(data, n)


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_term_frequencies(spark, hot):
    rng = np.random.default_rng(4)
    data = [("the", "r1", 1.0) if rng.random() < hot else (None if rng.random() < 0.05 else f"t{rng.integers(12)}", f"r{rng.integers(6)}" if rng.random() < 0.9 else None, float(rng.integers(3)) if rng.random() < 0.9 else float("nan")) for _ in range(900)]
    df = spark.createDataFrame(data, "t string, r string, w double").withColumn("part", F.lit(0)).repartition(5)
    got = {r.term: (r.occurrences, r.total_weight, r.records) for r in terms.term_frequencies(terms.term_rows(df, F.col("t"), F.col("r"), F.col("w"))).collect()}
    want = defaultdict(lambda: [0, 0.0, set()])
    for t, r, w in data:
        if t is not None and r is not None:
            x = want[t]
            x[0] += 1
            x[1] += 0.0 if math.isnan(w) else w
            x[2].add(r)
    assert got == {t: (a, b, len(c)) for t, (a, b, c) in want.items()}
    assert terms.term_frequencies(terms.term_rows(df.limit(0), F.col("t"), F.col("r"), F.col("w"))).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d"]), min_size=1, max_size=30), st.integers(1, 6))
def test_terms_are_ngrams_of_one_token(spark, words, parts):
    """Both paths use the same intervals; ranges and batches may cut them anywhere."""
    data = [(w, f"r{i % 3}", 1.0) for i, w in enumerate(words)]
    df = spark.createDataFrame(data, "t string, r string, w double").repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        a = {(r.term, r.occurrences, r.records) for r in terms.term_frequencies(terms.term_rows(df, F.col("t"), F.col("r"), F.col("w"))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(w, words.count(w), len({r for t, r, _ in data if t == w})) for w in words}
    assert a == want


def test_marks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 6), ("d", 5)], "term string, records long")
    assert {r.term: r.mark for r in terms.mark_terms(df, F.lit(100)).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}


def test_percentiles(spark):
    rng = np.random.default_rng(9)
    data = [(f"w{rng.integers(3)}" if rng.random() < 0.9 else None, "hot" if rng.random() < 0.5 else f"t{rng.integers(30)}", float(rng.choice([0.001, 0.5, rng.random()]))) for _ in range(700)] + [("w9", "x", None), ("w9", "x", float("nan"))]
    df = spark.createDataFrame(data, "w string, t string, x double").withColumn("level", F.lit(3))
    levels = {"week": {"w": F.col("w")}, "both": {"w": F.col("w"), "t": F.col("t")}}
    rows = lambda d: percentiles.group_rows(d, levels, F.col("x"), F.col("x") > 0)
    counts = percentiles.group_counts(rows(df))
    parts = [rows(d) for d in (df.where("x < 0.3"), df.where("x >= 0.3"))]
    halves = percentiles.merge_counts(*map(percentiles.group_counts, parts))
    whole = percentiles.merge_sketches(*map(percentiles.group_sketch, parts))
    same = lambda d: sorted(str((*r[:-3], r[-3] and round(r[-3], 9), *r[-2:])) for r in d.collect())
    assert same(whole) == same(percentiles.group_sketch(rows(df)))
    by = defaultdict(list)
    for w, t, x in data:
        if w is not None and x is not None and x == x:
            by["week", w, None].append(x)
            by["both", w, t].append(x)
    for c in (counts, halves, rows(df)):
        got = percentiles.bisect_percentiles(c, (0.1, 0.5, 0.9), levels=3).collect()
        assert {(r.level, r.w, r.t) for r in got} == set(by)
        for r in got:
            v = sorted(by[r.level, r.w, r.t])
            assert r.lo == r.hi == v[max(1, math.ceil(round(r.percentile * len(v), 6))) - 1]
    assert percentiles.bisect_percentiles(counts.limit(0)).count() == 0
    for r in percentiles.bisect_percentiles(counts, (0.5,), levels=1, tolerance=0.1).collect():
        v = sorted(by[r.level, r.w, r.t])
        assert r.lo <= v[math.ceil(len(v) / 2) - 1] <= r.hi and r.hi - r.lo <= 0.1


def test_rounded_error(spark):
    x = [(0.1234567,), (1e-9,), (0.0,), (123.456,)]
    for a, b in spark.createDataFrame(x, "x double").select("x", percentiles.rounded(F.col("x"), 10)).collect():
        assert abs(a - b) <= abs(a) * 2**-10
