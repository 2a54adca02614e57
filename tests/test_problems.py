"""The general data problems against brute force, with nulls, ties, empty tables and skew."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import compaction, hotkeys, selection, spikes
from tallyloom.plans import problems


def nearest(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(round(q * len(v), 6))) - 1]


@pytest.mark.parametrize("cells,few,limit", [(2, 0, 0), (16, 0, 6 << 20), (256, 8, 0), (256, 4096, 6 << 20)])
def test_ranks_are_exact(spark, cells, few, limit):
    rng = np.random.default_rng(cells)
    data = [("hot", float(x)) for x in rng.lognormal(0, 4, 900)] + [("tie", 0.25)] * 50 + [("two", 1e-300), ("two", 1e300), (None, 3.0), ("neg", -1.0), ("neg", -2.0), ("neg", 0.0), ("nan", float("nan")), ("nan", None)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {(r.k, r.q): (r.lo, r.hi, r.n_rows) for r in selection.refine_ranks(selection.value_counts(df, ["k"], "x").cache(), ["k"], (0.0, 0.25, 0.5, 0.99), cells=cells, few=few, limit=limit).collect()}
    by = defaultdict(list)
    for k, x in data:
        if x is not None and x == x:
            by[k].append(x)
    assert {k for k, _ in got} == set(by)
    for (k, q), (lo, hi, n) in got.items():
        assert lo == hi == nearest(by[k], q) and n == len(by[k])


def test_ranks_of_cold_keys(spark):
    """With many keys most are cold and meet their intervals in a join."""
    rng = np.random.default_rng(4)
    data = [(f"k{rng.integers(3000)}" if rng.random() < 0.6 else "hot", float(rng.choice([rng.normal(), 1.0, 1.0000001, -3.0]))) for _ in range(12_000)]
    by = defaultdict(list)
    for k, x in data:
        by[k].append(x)
    df = spark.createDataFrame(data, "k string, v double")
    for limit in (0, 6 << 20):
        got = {(r.k, r.q): (r.lo, r.hi, r.n_rows) for r in selection.refine_ranks(df, ["k"], (0.3, 0.5), few=2, limit=limit).collect()}
        assert got == {(k, q): (nearest(v, q), nearest(v, q), len(v)) for k, v in by.items() for q in (0.3, 0.5)}


def test_value_sketches_merge(spark):
    df = spark.createDataFrame([("a", x) for x in (0.5, 0.5, -2.0, 0.0, None, 1e-9)], "k string, v double")
    parts = [selection.value_sketch(df.where(c), ["k"]) for c in ("v > 0", "v <= 0 or v is null")]
    assert sorted(map(str, selection.merge_sketches(*parts).collect())) == sorted(map(str, selection.value_sketch(df, ["k"]).collect()))


def test_ranks_bounded_and_merged(spark):
    df = spark.createDataFrame([(i % 3, float(i) / 7) for i in range(400)], "k int, x double")
    a, b = selection.value_counts(df.where("x < 20"), ["k"], "x"), selection.value_counts(df.where("x >= 20"), ["k"], "x")
    whole = selection.value_counts(df, ["k"], "x")
    both = selection.merge_counts(a, b)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))
    for r in selection.refine_ranks(both.cache(), ["k"], (0.5,), cells=4, tolerance=1.0).collect():
        exact = nearest([i / 7 for i in range(400) if i % 3 == r.k], 0.5)
        assert r.lo <= exact <= r.hi and r.hi - r.lo <= 1.0
    empty = selection.value_counts(df.limit(0), ["k"], "x")
    assert selection.refine_ranks(empty, ["k"], (0.5,)).count() == 0


def brute_flags(rows, least=4, ratio=3, few=30):
    out = set()
    by_user, by_pair = defaultdict(list), defaultdict(lambda: defaultdict(set))
    for i, u, t, w, x in rows:
        if x is None:
            continue
        ok = math.isfinite(x) and 0 < x <= 1
        if not ok:
            out.add(i)
        if u is not None and ok:
            by_user[u].append(x)
        if None not in (u, t, w) and math.isfinite(x):
            by_pair[u, t][w].add(x)
    jump = {}
    for u, v in by_user.items():
        v.sort()
        for k in range(1, len(v)):
            if len(v) >= few and v[k] >= ratio * v[k - 1] and 2 * k >= len(v):
                jump[u] = v[k]
                break
    stuck = set()
    for (u, t), weeks in by_pair.items():
        order = sorted(weeks)
        for x in {x for s in weeks.values() for x in s}:
            run = []
            for w in [*order, None]:
                if w is not None and x in weeks[w]:
                    run.append(w)
                else:
                    if len(run) >= least:
                        stuck |= {(u, t, r, x) for r in run}
                    run = []
    for i, u, t, w, x in rows:
        if x is not None and ((u, t, w, x) in stuck or (u in jump and math.isfinite(x) and 0 < x <= 1 and x >= jump[u])):
            out.add(i)
    return out


def flag(spark, rows):
    df = spark.createDataFrame(rows, "i long, u string, t string, w int, x double").withColumns({"source": F.lit(1), "row_id": F.lit("clash"), "fence": F.lit(0)})
    got = spikes.flag_readings(df, F.col("i"), F.col("u"), F.col("t"), F.col("w"), F.col("x")).where("impossible or stuck or (outside and reading >= jump)")
    return {r.row_id for r in got.collect()}


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000))
def test_flags_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda a, p=None: a[rng.choice(len(a), p=p)]
    rows = []
    for i in range(500):
        x = pick([0.01, 0.011, 0.02, 0.03, 0.05, 0.4, 0.9, 1.0, 0.0, -0.1, 1.5, float("nan"), float("inf"), None], [0.3, 0.2, 0.15, 0.1, 0.1, 0.03, 0.01, 0.01, 0.02, 0.02, 0.02, 0.01, 0.01, 0.02])
        rows.append((i, pick(["a", "b", "c", None], [0.6, 0.2, 0.1, 0.1]), pick(["s", "t", None]), pick([1, 2, 3, 4, 5, 6, None]), x))
    assert flag(spark, rows) == brute_flags(rows)


def test_flag_edges(spark):
    assert flag(spark, []) == set()
    same = [(i, "u", "t", 1, 0.5) for i in range(40)]  # one week only: not stuck
    assert flag(spark, same) == set()
    run = [(i, "u", "t", w, 0.25) for i, w in enumerate([1, 3, 9, 10, 10])]
    assert flag(spark, run) == {0, 1, 2, 3, 4}


def test_fences_by_context_and_steps(spark):
    """An evening reading that is ordinary at noon is outside the evening's fence, below a low fence too; only a sudden one is steep."""
    rows = [(i, "u", "t", 1, 0.10 + i / 1000, 12) for i in range(40)] + [(100 + i, "u", "t", 2, 0.040 + i / 10_000, 20) for i in range(40)]
    rows += [(200, "u", "n", 1, 0.042, 20), (201, "u", "n", 2, 0.13, 20), (202, "u", "m", 1, 0.09, 20), (203, "u", "m", 2, 0.1, 20), (204, "u", None, None, 0.004, 20), (205, "v", "n", 1, 0.9, 20), (206, "u", "z", 1, 0.12, None)]
    df = spark.createDataFrame(rows, "i long, u string, t string, w int, x double, h int")
    got = {r.row_id: (r.outside, r.steep) for r in spikes.flag_readings(df, F.col("i"), F.col("u"), F.col("t"), F.col("w"), F.col("x"), context=F.col("h")).collect()}
    assert {i: got.get(i) for i in (201, 202, 203, 204)} == {201: (True, True), 202: (True, False), 203: (True, False), 204: (True, False)}
    assert set(got) == {201, 202, 203, 204}  # 206 has no hour and takes the source's fence, v has too few readings


def test_steep_changes_are_a_reason_of_their_own(spark):
    """Rises and falls by three times inside a wide fence, also of a source that has no fence; several readings at a step are all to be passed."""
    rows = [(i, "u", f"t{i}", 1, 0.01 + i / 100) for i in range(40)]
    rows += [(100, "u", "up", 1, 0.02), (101, "u", "up", 2, 0.35), (102, "u", "up", 3, 0.2), (110, "u", "down", 1, 0.36), (111, "u", "down", 4, 0.03), (112, "u", "down", 5, 0.05)]
    rows += [(120, "u", "two", 1, 0.1), (121, "u", "two", 1, 0.3), (122, "u", "two", 2, 0.05), (123, "u", "two", 2, 0.35), (124, "u", "two", 3, 0.015), (125, "u", "two", 3, 0.015)]
    rows += [(130, "v", "n", 1, 0.1), (131, "v", "n", 2, 0.5), (132, None, "n", 3, 0.1), (133, "v", "n", None, 0.01), (134, "v", None, 3, 0.01), (135, "v", "n", 3, None), (136, "v", "n", 4, 0.4)]
    df = spark.createDataFrame(rows, "i long, u string, t string, w int, x double")
    got = {r.row_id: (r.impossible, r.stuck, r.outside, r.steep) for r in spikes.flag_readings(df, F.col("i"), F.col("u"), F.col("t"), F.col("w"), F.col("x")).collect()}
    assert got == dict.fromkeys((101, 111, 124, 125, 131), (False, False, False, True))


def test_steep_steps_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(f"u{rng.integers(4)}", f"t{rng.integers(12)}", int(rng.integers(1, 9)), float(rng.choice([0.01, 0.02, 0.03, 0.1, 0.3, 0.9, 1.0, 1.2, 0.0, math.nan]))) for _ in range(300)]
    by_pair = {}
    for u, t, w, x in rows:
        if 0 < x <= 1:
            by_pair.setdefault((u, t), {}).setdefault(w, set()).add(x)
    want = set()
    for (u, t), weeks in by_pair.items():
        order = sorted(weeks)
        for a, b in zip(order, order[1:]):
            want |= {(u, t, b, x) for x in weeks[b] if x >= 3 * max(weeks[a]) or x * 3 <= min(weeks[a])}
    df = spark.createDataFrame(rows, "u string, t string, w int, x double")
    got = spikes.steep_steps(df, "u", "t", "w", "x").collect()
    assert len(want) > 20 and sorted((r.u, r.t, r.w, r.x) for r in got) == sorted(want)
    assert all(r.change >= 3 or r.change <= 1 / 2.99 for r in got)


def test_found_readings_pass_all_steps(spark, folder, monkeypatch):
    """p5_found narrows the rows of the whole operator, changes between steps included."""
    done, steep_steps = [], spikes.steep_steps
    monkeypatch.setattr(spikes, "steep_steps", lambda *a, **k: done.append(1) or steep_steps(*a, **k))
    found = {r.row_id for r in problems.p5_found(spark, folder).collect()}
    assert done == [1] and found <= {r.row_id for r in problems.p5_flags(spark, folder).collect()}


def test_sketches_merge(spark):
    df = spark.createDataFrame([("u", float(i + 1) / 100, i % 4) for i in range(60)], "source string, x double, h int")
    parts = spikes.merge_sketches(spikes.source_sketch(df, "source", "x", "h"), ["source"])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, spikes.source_sketch(df, "source", "x").collect()))


def test_key_report(spark):
    rng = np.random.default_rng(2)
    data = [(("hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"k{rng.integers(60)}"), f"u{rng.integers(9)}" if rng.random() < 0.9 else None, float(pick) if (pick := rng.choice([0.1, 0.2, 0.5, 2.0, 0.0])) else None) for _ in range(1500)]
    df = spark.createDataFrame(data, "k string, u string, x double").withColumns({"key_value": F.lit(1), "n": F.lit(2), "v": F.lit(3)})
    got = {r.key_value: r for r in hotkeys.key_report(df, {"f": F.col("k")}, F.col("x"), F.col("u"), (0.5,), 0.02).collect()}
    by = defaultdict(list)
    for k, u, x in data:
        if k is not None:
            by[k].append((u, x))
    assert set(got) == set(by)
    for k, v in by.items():
        r, ok = got[k], [x for _, x in v if x is not None and 0 < x <= 1]
        assert r.n_rows == len(v) and r.n_members == len({u for u, _ in v if u}) and r.n_valid == len(ok) and r.hot == (len(v) > 0.02 * len(data))
        assert (r["q50"] is None and not ok) or (r["q50"] == nearest(ok, 0.5) and abs(r.mean_value - sum(ok) / len(ok)) < 1e-12)
    assert hotkeys.key_report(df.limit(0), {"f": F.col("k")}, F.col("x"), F.col("u")).count() == 0


FIELDS = ["a", "b"]


def bodies(spark, data):
    return compaction.parse_files(spark.createDataFrame(data, "file_id long, body string"), F.col("file_id"), F.col("body"), FIELDS)


def test_consolidation_and_redundant_files(spark, tmp_path):
    data = [
        (1, '1,x\n2,"y\nz"\n'), (2, '7\t"1","x"\r\n'), (3, "1,x\n"), (4, '"2","y\nz"\n1,x\n'), (5, ""), (6, None), (7, "only,one,too\n"), (8, "1,NULL\n1,x\n2,\"y\nz\"\n"), (9, "9,9\n9,9\n"), (10, "9,9"),
    ]
    got = compaction.consolidate(bodies(spark, [*data, (None, "9,9"), ((1 << 60) + 1, "2,only here")]), FIELDS, str(tmp_path / "first"))
    assert got.n_records == 5 and {r.file_id for r in got.holders.collect()} >= {1, (1 << 60) + 1} and got.holders.where("file_id is null").count() == 0
    got = compaction.consolidate(bodies(spark, data), FIELDS, str(tmp_path / "out"))
    assert sorted(map(tuple, got.records.collect()), key=str) == sorted([("1", "x"), ("2", "y\nz"), ("1", None), ("9", "9")], key=str)
    assert (got.n_rows, got.n_rejected, got.n_in, got.n_copies, got.n_records) == (13, 1, 12, 8, 4)
    assert [tuple(r) for r in got.rejected.collect()] == [(7, "only,one,too")]
    found = {r.file_id: r.reason for r in compaction.redundant_files(got.holders).collect()}
    assert {f for f in found} == {1, 2, 3, 4, 10} and found[10] == "same"
    again = compaction.consolidate(bodies(spark, data[:1]), FIELDS, str(tmp_path / "out"), target_bytes=8)
    assert again.records.count() == 2 and again.n_files > 1
    none = compaction.consolidate(bodies(spark, data[4:6]), FIELDS)
    assert none.records.count() == 0 and compaction.redundant_files(none.holders).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 1000))
def test_redundant_files_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    sets = {i: frozenset(rng.choice(12, rng.integers(0, 7)).tolist()) for i in range(60)}
    data = [(i, "".join(f"{x},y\n" for x in s)) for i, s in sets.items()]
    holders = bodies(spark, data).select("file_id", F.col("a").cast("long").alias("row")).distinct()
    want = {i for i, s in sets.items() if s and any(j != i and (s < t or (s == t and j < i)) for j, t in sets.items())}
    assert {r.file_id for r in compaction.redundant_files(holders).collect()} == want


def test_membership_comes_from_what_was_written(spark):
    """A record that isn't in the consolidated table is nobody's."""
    made = compaction.consolidate(bodies(spark, [(1, "1,x\n2,y\n"), (2, "1,x\n")]), FIELDS)
    assert made.holders.select("row").distinct().count() == made.records.count() == 2


def test_failed_swap_keeps_the_old_folder(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "kept").write_text("x")
    with pytest.raises(Exception):
        compaction.swap_folder(spark, str(tmp_path / "missing"), str(tmp_path / "old"))
    assert (tmp_path / "old" / "kept").read_text() == "x"


def test_small_files_are_read(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.csv").write_text(f'{i},"é\nx"\nbad\n', encoding="utf-8")
    rows = compaction.read_small_files(spark, str(tmp_path), FIELDS)
    got = compaction.consolidate(rows, FIELDS)
    assert (got.n_rows, got.n_rejected, got.n_records) == (10, 5, 5) and {r.b for r in got.records.collect()} == {"é\nx"}


def test_interpolated_percentiles(spark):
    rng = np.random.default_rng(8)
    data = [(k, float(rng.choice([1.0, 2.0, rng.normal()]))) for k in "aab" for _ in range(77)] + [("one", 5.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {(r.k, r.q): r.value for r in selection.interpolated_percentiles(selection.value_counts(df, ["k"], "x").cache(), ["k"], (0.0, 0.3, 0.5, 1.0)).collect()}
    by = defaultdict(list)
    for k, x in data:
        by[k].append(x)
    assert len(got) == 4 * len(by)
    for (k, q), v in got.items():
        assert abs(v - np.percentile(by[k], 100 * q)) < 1e-12
    whole = selection.interpolated_percentiles(selection.value_counts(df, [], "x").cache(), [], (0.5,)).collect()
    assert abs(whole[0].value - np.median([x for _, x in data])) < 1e-12
    assert selection.interpolated_percentiles(selection.value_counts(df.limit(0), [], "x").cache(), [], (0.5,)).count() == 0
