"""Operators of the domain's stages against worked values, plain Python and their own invariants."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import features, geo, lexicon, messages, ngrams, stats, trends, weights
from tallyloom.plans import pipeline

FEATURE = "group_id string, feat string, value double, group_norm double"


def rows(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in (df.select(*cols) if cols else df).collect())


def test_ngram_norms(spark):
    df = spark.createDataFrame([("g", "a a a b"), ("g", ""), (None, "a"), ("h", None), ("h", "x")], "g string, m string")
    out = ngrams.extract_ngrams(df, "g", "m", tokenize=X.whitespace_tokens)
    assert rows(out) == [("g", "a", 3.0, 0.75), ("g", "b", 1.0, 0.25), ("h", "x", 1.0, 1.0)]
    assert rows(ngrams.extract_ngrams(df, "g", "m", tokenize=X.whitespace_tokens, min_value=2)) == [("g", "a", 3.0, 0.75)]
    assert rows(ngrams.extract_ngrams(df, "g", "m", (2,), tokenize=X.whitespace_tokens)) == [("g", "a a", 2.0, 0.666667), ("g", "a b", 1.0, 0.333333)]
    doubled = ngrams.extract_ngrams(df, "g", "m", tokenize=X.whitespace_tokens, value_func=lambda v: v * v)
    assert ("g", "a", 9.0, 0.9) in rows(doubled)


def test_rare_features(spark):
    df = spark.createDataFrame([("g1", "a", 1.0, 0.5), ("g1", "b", 1.0, 0.5), ("g2", "a", 2.0, 1.0)], FEATURE)
    assert rows(features.fold_rare(df, 1.0)) == [("g1", "<OOV>", 1.0, 0.5), ("g1", "a", 1.0, 0.5), ("g2", "<OOV>", 0.0, 0.0), ("g2", "a", 2.0, 1.0)]


def test_lexicon_scores(spark):
    f = spark.createDataFrame([("g", "sad", 2.0, 0.4), ("g", "ok", 3.0, 0.6), ("g2", "xyz", 1.0, 1.0), ("g2", "_intercept", 9.0, 0.0)], FEATURE)
    lex = spark.createDataFrame([("sad", "DEP", 1.5, 1), ("sad", "DEP", 9.0, 0), ("ok", "ANX", 0.5, 2), ("_intercept", "DEP", 2.0, 3), ("_intercept", "ANX", 1.0, 4), (None, "DEP", 1.0, 5)], "term string, category string, weight double, position int")
    w = lexicon.last_weights(lex, "position")
    assert rows(lexicon.score(f, w)) == [("g", "ANX", 3.0, 1.3), ("g", "DEP", 2.0, 2.6), ("g2", "ANX", 0.0, 1.0), ("g2", "DEP", 0.0, 2.0)]
    assert rows(lexicon.score(f, w, False, True)) == [("g", "ANX", 3.0, 1.3, 1.5), ("g", "DEP", 2.0, 2.6, 3.0)]
    assert rows(lexicon.category_counts(f, w)) == [("g", "ANX", 3.0), ("g", "DEP", 2.0)]


def test_anscombe(spark):
    df = spark.createDataFrame([("g", "a", 2.0, 0.0), ("g", "b!", 3.0, 0.0), ("g", "@u", 3.0, 0.0), ("g", "..", 1.0, 0.0)], FEATURE)
    assert rows(features.anscombe_rebase(df)) == [("g", "a", 3.082207, 0.456188), ("g", "b", 3.674235, 0.543812)]
    kept = features.merge_repeated(spark.createDataFrame([("g", "a", 1.0, 0.1), ("g", "a", 2.0, 0.2)], FEATURE), "compat")
    assert rows(kept) == [("g", "a", 2.0, 0.2)]


def test_weights_and_counties(spark):
    f = spark.createDataFrame([("g1", "a", 4.0, 0.2), ("g2", "a", 3.0, 0.1), (":g", "a", 1.0, 0.1)], FEATURE)
    w = geo.group_weights(spark.createDataFrame([("g1", 0.5), (":g", 3.0), ("g1", None)], "user_id string, weight double"))
    assert rows(geo.add_weight(f, w), "group_id", "weight") == [("g1", 0.5), ("g2", 1.0)]
    assert rows(geo.reweight(f, w)) == [(":g", "a", 1.0, 0.1), ("g1", "a", 2.0, 0.1), ("g2", "a", 3.0, 0.1)]
    assert geo.reweight(f, w, "drop").count() + geo.reweight(f, w, "only").count() == f.count()
    users = geo.user_counties(spark.createDataFrame([(7, 1003, 0), (7, 2003, 1), (8, None, 0)], "user_id long, cnty int, p int"), position="p")
    g = spark.createDataFrame([("2020_09:7", "a", 1.0, 0.1), ("2020_09:x", "a", 1.0, 0.1), ("bad", "a", 1.0, 0.1)], FEATURE)
    assert rows(geo.add_county(g, users), "group_id", "cnty") == [("2020_09:7", "02003")]
    assert geo.without_county(g, users).count() == 2


def test_place_aggregate(spark):
    df = spark.createDataFrame([("2020_09:1", "D", 1.0, 1.0, "01003", 2.0), ("2020_09:2", "D", 1.0, 3.0, "01003", 1.0), (":2", "D", 1.0, 3.0, "01003", 1.0)], FEATURE + ", cnty string, weight double")
    out = geo.aggregate_places(df)
    assert rows(out, "key", "wavg_score", "avg_score", "std_score", "N_users", "Space", "Time") == [("2020_09:01003", 1.666667, 2.0, 1.0, 2, "01003", "2020_09")]
    assert geo.with_min_users(out, 3).count() == 0


def test_super_counties(spark):
    df = spark.createDataFrame([("2020_09:1", "D", 2.0, 1.0, "a", "2020_09"), ("2020_09:2", "D", 4.0, 3.0, "b", "2020_09"), ("2020_09:3", "D", 1.0, 5.0, "c", "2020_09"), ("2020_09:4", "D", 1.0, 5.0, "z", "2020_09")], FEATURE + ", cnty string, yw string")
    m = spark.createDataFrame([("a", "S", 0.25), ("b", "S", 0.75), ("c", "C", 1.0), ("z", None, 1.0)], "cnty string, super_cnty string, super_weight double")
    assert rows(geo.spread_super_counties(df, m), "cnty", "value", "group_norm") == [("S", 3.5, 2.5), ("S", 3.5, 2.5), ("c", 1.0, 5.0)]


def test_poststratification(spark):
    dem = weights.Demographic("income", (0.0, 10.0, 20.0), ("p1", "p2"))
    users = spark.createDataFrame([(i, "c", "w", float(i)) for i in range(5)] + [(10 + i, "c", "w", 10.0 + i) for i in range(5)] + [(99, "x", "w", 1.0)], "user_id long, cnty string, yw string, income double")
    census = spark.createDataFrame([("c", 20.0, 80.0)], "cnty string, p1 double, p2 double")
    out = {r.user_id: r.weight for r in weights.poststratify(users, census, dem).collect()}
    assert len(out) == 10 and abs(out[0] - 0.571429) < 1e-6 and abs(out[12] - 1.230769) < 1e-6
    plain = {r.user_id: r.weight for r in weights.poststratify(users, census, dem, uninformed=True).collect()}
    assert abs(plain[0] - 0.4) < 1e-9 and abs(plain[12] - 1.6) < 1e-9
    merged = {r.user_id: r.weight for r in weights.poststratify(users, census, dem, min_bin=6).collect()}
    assert set(merged.values()) == {1.0}
    same = {r.user_id: r.weight for r in weights.poststratify(users, census, dem, min_bin=1).collect()}
    assert all(abs(same[k] - out[k]) < 1e-9 for k in out)


def test_collapse_rules():
    assert weights.collapse([1, 5, 1, 9], [0, 1, 2, 3, 4], 3) == ([7, 9], [0, 3, 4])  # the first of equal ones, then the smaller neighbour
    assert weights.collapse([4, 1, 4], [0, 1, 2, 3], 2) == ([4, 5], [0, 1, 3])  # both neighbours equal: the right one
    assert weights.collapse([4, 3, 1], [0, 1, 2, 3], 2) == ([4, 4], [0, 1, 3])
    assert weights.collapse([0, 0], [0, 1, 2], 1) == ([0], [0, 2])


def test_redistribution(spark):
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(10, 1, 500))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, income double")
    out = sorted((r.income, r.income_redist) for r in weights.redistribute_incomes(df).collect())
    assert out[-1][1] is None and all(v is not None for _, v in out[:-1])
    assert all(a[1] <= b[1] for a, b in zip(out[:-2], out[1:-1]))
    shares = np.histogram([v for _, v in out[:-1]], [0, 30e3, 50e3, 75e3, 1e12])[0] / 500
    assert np.abs(shares - weights.TARGET_SHARES).max() < 0.01
    assert weights.redistribute_incomes(df, repair_top=True).where("income_redist is null").count() == 0


def test_outliers_and_scaling(spark):
    df = spark.createDataFrame([(f"g{i}", "D", 1.0, 0.0 if i else 100.0, "w") for i in range(20)] + [("x", "D", 1.0, 1.0, "")], FEATURE + ", yw string")
    out = {r.group_id: r.group_norm for r in features.reset_outliers(df).collect()}
    assert out["g0"] == 5.0 and out["g1"] == 0.0 and "x" not in out
    scaled = {r.group_id: r.group_norm for r in features.scale_min_max(df).collect()}
    assert scaled["g0"] == 5.0 and scaled["g1"] == 0.0 and scaled["x"] == 0.05
    z = features.clamp_scores(df, standardize=True).agg(F.avg("group_norm"), F.stddev_pop("group_norm")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9


def test_trends(spark):
    panel = spark.createDataFrame([("A", "2020_01", 5.0), ("A", "2019_01", 3.0), ("B", "2020_02", 1.0), ("B", "2019_02", 5.0), ("A", "2020_03", 1.0)], "c string, w string, v double")
    assert rows(trends.year_over_year(panel, "c", "w", "v"), "c", "diff") == [("A", 6.0), ("B", 0.0)]
    full = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "3"), ("B", "1"), ("B", "2")], "c string, w string")
    assert rows(trends.full_coverage(full, "c", "w").select("c").distinct()) == [("A",)]
    top = spark.createDataFrame([("m", "a", 1), ("m", "b", 2), ("m", "c", 2), ("n", "d", 0)], "g string, c string, p int")
    assert rows(trends.largest_per(top, "g", "p")) == [("m", "b", 2), ("m", "c", 2), ("n", "d", 0)]
    assert trends.largest_per(top, "g", "p", ties=False).count() == 2


def test_reliability_matches_plain_python(spark):
    x = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame([("g", v) for v in x] + [("g", None), ("h", 1.0), ("h", 1.0), ("h", 1.0), (None, 2.0)], "g string, v double")
    out = {r.g: r for r in stats.reliability(df, "g", "v").collect()}
    assert (out["g"].effect, out["g"].effect_se) == stats.split_half_d(sorted(x), 3, 30)
    assert out["h"].effect is None and not out["h"].reliable and set(out) == {"g", "h"}
    again = {r.g: r for r in stats.reliability(df.orderBy(F.desc("v")), "g", "v").collect()}
    assert again["g"].effect == out["g"].effect
    assert math.isnan(stats.split_half_h([2.0, 3.0, 4.0])[0]) and stats.split_half_h([0.0, 1.0, 0.0, 1.0])[0] >= 0


def test_distributions():
    # table values of F and t
    assert abs(stats.f_tail(4.9646, 1, 10) - 0.05) < 1e-4 and abs(stats.f_tail(3.3258, 5, 10) - 0.05) < 1e-4
    assert abs(stats.t_tail(2.2281, 10) - 0.05) < 1e-4 and abs(stats.t_tail(1.96, 1e6) - 0.05) < 1e-3
    assert stats.f_tail(0.0, 3, 3) == 1.0


def test_icc_and_regressions(spark):
    rng = np.random.default_rng(5)
    data = [(f"g{i}", float(i % 5 + rng.normal()), float(i % 5)) for i in range(60) for _ in range(4)]
    df = spark.createDataFrame([(g, y, x + float(rng.normal())) for g, y, x in data], "g string, y double, x double")
    r = stats.icc(df, "y", "g", (0, 10)).collect()
    assert len(r) == 1 and 0.3 < r[0].icc1 < 0.95 and r[0].p_value < 1e-6
    one = stats.icc(df.where("g = 'g1'"), "y", "g").first()
    assert one.f is None and one.icc1 is None
    y = np.array([d.y for d in df.collect()])
    x = np.array([d.x for d in df.collect()])
    fit = stats.simple_ols(df, "y", "x").first()
    assert abs(fit.slope - np.polyfit(x, y, 1)[0]) < 1e-9 and fit.slope_p < 1e-6
    mixed = stats.random_intercept(df, "y", "x", "g").first()
    assert mixed.n_groups == 60 and 0.2 < mixed.var_residual < 3 and mixed.var_group >= 0


def test_reml_balanced_anova():
    """Without a slope effect the REML variance of balanced groups is the ANOVA estimate."""
    rng = np.random.default_rng(1)
    y = np.repeat(rng.normal(0, 2, 30), 8) + rng.normal(0, 1, 240)
    x = np.tile(np.arange(8.0), 30)
    g = [(8, x[i : i + 8].sum(), y[i : i + 8].sum(), (x[i : i + 8] ** 2).sum(), (x[i : i + 8] * y[i : i + 8]).sum(), (y[i : i + 8] ** 2).sum()) for i in range(0, 240, 8)]
    out = stats.reml(np.array(g))
    means = y.reshape(30, 8).mean(1)
    b = sum((x - 3.5) * y) / sum((x - 3.5) ** 2)
    resid = y - b * (x - 3.5) - np.repeat(means, 8)
    msw = (resid**2).sum() / (240 - 30 - 1)
    assert abs(out[6] - msw) < 1e-3 and abs(out[5] - (means.var(ddof=1) - msw / 8)) < 1e-2


def test_messages(spark):
    kind = "message_id string, user_id string, message string, created_at string, date2 string, date3 string"
    d = "2020-02-24 10:00:00"
    data = [("1", "u", "one two three four five six seven", d, None, None), ("2", "u", "one two three four five six eight", d, None, None), ("3", "u", "RT one", d, None, None), ("4", "u", None, d, None, None), ("5", None, "x", d, None, None), ("6", "v", '"hello you all"', "bad", d, None), ("7", "v", "see http://a.b/c", d, None, None)]
    df = spark.createDataFrame(data, kind)
    clean = messages.clean_messages(df, "message", "user_id", ["message_id"])
    assert rows(clean, "message_id", "message") == [("1", "one two three four five six seven"), ("6", "hello you all")]
    again = messages.clean_messages(clean, "message", "user_id", ["message_id"])
    assert rows(again) == rows(clean)
    keyed = messages.key_messages(df, "user_id", ["created_at", "date2", "date3"])
    assert Counter(r.group_id for r in keyed.collect()) == {"2020_09:u": 4, "2020_09:v": 2}
    assert messages.with_min_posts(keyed, "group_id", 3).count() == 4
    assert messages.drop_incomplete(df, 2, 1).count() == 5


def test_language_filter(spark):
    texts = ["the cat is on my mat and it is so good", "Guten Tag und der Hund ist nicht auf dem Sofa", "NULL", "  ", None, "zzz"]
    df = spark.createDataFrame([(str(i), t, "NULL") for i, t in enumerate(texts)], "id string, message string, extra string")
    out = messages.filter_language(df, "message", ["en"]).collect()
    assert [(r.id, r.lang, r.extra) for r in out] == [("0", "en", None)]
    assert {r.lang for r in messages.filter_language(df, "message").collect()} == {"en", "de"}


def test_clashing_names_and_empty(spark):
    """Extra columns named like internal ones and empty tables."""
    df = spark.createDataFrame([("g", "a", 1.0, 1.0, 5)], FEATURE + ", _total int")
    assert ngrams.with_group_norm(df.drop("_total")).count() == 1
    none = spark.createDataFrame([], FEATURE)
    assert features.fold_rare(none, 0.5).count() == 0 and features.anscombe_rebase(none).count() == 0
    lex = spark.createDataFrame([], "term string, category string, weight double")
    assert lexicon.score(none, lex).count() == 0
    assert geo.aggregate_places(none.selectExpr("*", "'' as cnty", "1.0 as weight")).count() == 0


def test_pipeline_runs(spark, folder):
    from tallyloom.plans.tables import table

    out = pipeline.run(table(spark, folder, "messages"), table(spark, folder, "lexicon"), table(spark, folder, "user_county"), table(spark, folder, "group_weight"), pipeline.Settings(least_posts=1, lexicon_only=True))
    assert out.count() > 0 and out.where("wavg_score < 0 or wavg_score > 5").count() == 0


@pytest.mark.parametrize("text,fields", [('1,"a ""b""",c', ["1", 'a "b"', "c"]), ('12\t"1","x","NULL"', ["1", "x", None])])
def test_repaired_lines(text, fields):
    from tallyloom.operators.compaction import parse_rows

    assert list(parse_rows(text, 3)) == [fields]


def test_sources(spark, tmp_path):
    from tallyloom.sources import tables as S

    df = spark.createDataFrame([("1", "u", 'say "hi",\nyou', None, "a", "b")], S.MESSAGES)
    S.write_csv(df, str(tmp_path / "m"))
    assert rows(S.read_csv(spark, str(tmp_path / "m"), S.MESSAGES)) == rows(df)
    with pytest.raises(Exception, match="already exists"):
        S.write_csv(df, str(tmp_path / "m"))
    (tmp_path / "lines.csv").write_text('7\t"1","u","it is \\"so\\"","a","b",NULL\nbroken\n')
    got = S.read_repaired_lines(spark, str(tmp_path / "lines.csv"), S.MESSAGES.names)
    assert [r.message for r in got.collect()] == ['it is "so"']
    (tmp_path / "lex.csv").write_text("term,category,weight\nsad,DEP,1.5\nbad,DEP,x\n")
    assert S.read_lexicon(spark, "lex", str(tmp_path)).where("weight is not null").count() == 1
    (tmp_path / "w.txt").write_text("b\na\n\nb\n")
    assert S.read_whitelist(spark, str(tmp_path / "w.txt")).first().words == ["a", "b"]
    calls = []
    for _ in range(2):
        S.compute_once(spark, str(tmp_path / "memo"), lambda: calls.append(1) or df)
    assert calls == [1]
    assert S.lineage_name("feat.1gram.upts", "score", "dd") == "feat.dd.upts" and S.lineage_name("x", "county") == "x.cnty"


def test_hashed_reliability(spark):
    rng = np.random.default_rng(3)
    data = [("big", i, float(rng.normal())) for i in range(3000)] + [("flat", i, 1.0) for i in range(9)] + [("few", 1, 2.0), ("big", 9999, None)]
    df = spark.createDataFrame(data, "g string, i long, v double")
    out = {r.g: r for r in stats.reliability_hashed(df, "g", "v", "i").collect()}
    assert out["big"].n == 3000 and out["big"].effect < 0.08 and out["big"].reliable
    assert out["flat"].effect is None and out["few"].effect is None and not out["few"].reliable
    exact = stats.reliability(df, "g", "v").where("g = 'big'").first()
    assert abs(exact.effect - out["big"].effect) < 0.05


def test_redistribution_of_nothing(spark):
    assert weights.redistribute_incomes(spark.createDataFrame([], "income double")).count() == 0


def test_stream_ngrams_holds_every_week(spark, folder):
    """The streamed weeks and those its watermark leaves open give what one batch over the table gives."""
    from tallyloom.plans import domain
    from tallyloom.plans.tables import table
    from tallyloom.streaming import counts

    rows = counts.with_event_time(table(spark, folder, "messages"), ["created_at", "date2", "date3"])
    want = Counter(tuple(r) for r in counts.weekly_ngrams(rows, "user_id", "message").collect())
    assert Counter(tuple(r) for r in domain.stream_ngrams(spark, folder).collect()) == want
