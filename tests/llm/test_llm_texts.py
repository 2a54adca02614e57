"""Languages, leaked items, packing and cut texts: held-out accuracy, brute force and edge cases."""

import difflib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import catalog, langid, leakage, packing, truncation
from tallyloom.plans.tables import table

# --- languages --------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    m = table(spark, "/root/testdata/sf0.01", "messages")
    return langid.fit_filter(m.where(F.xxhash64("message") % 2 == 0), F.col("message"), F.col("lang"))


def test_held_out_accuracy(spark, model):
    """Rows that weren't fitted: where the label names a language, it is nearly always found, though some labels are wrong."""
    m = table(spark, "/root/testdata/sf0.01", "messages").where(F.xxhash64("message") % 2 != 0).select("message_id", "message", langid.label_language(F.col("lang")).alias("label"))
    parts = langid.segment_languages(m, model, ["message_id", "label"], F.col("message"))
    got = langid.main_language(parts, ["message_id", "label"]).where(F.col("label").isin(*langid.LANGUAGES))
    right = got.where(F.array_contains("languages", F.col("label"))).count()
    assert right > 0.85 * got.count()


def test_mixed_and_edge_texts(spark, model):
    texts = [
        "The whole street in Dunmere is lonely because the heating works again. Me preocupa la lluvia más de lo que debería.",
        "the coach asked about the rent after the late shift c'est la vie https://lnk.example/x @bob #matin",
        "je me sens un peu perdue et je ne sais pas pourquoi", "", None, "the heating works again", "12 34 :-) 😂", "qzx wvk jjq xkcd vvbn zzqp",
        "the rent is all I think about today " * 4000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumns({"segment": F.lit(0), "lang": F.lit("zz")})
    got = {}
    for r in langid.segment_languages(df, model, ["id"], F.col("text")).collect():
        got.setdefault(r.id, []).append(r.lang)
    assert got[0] == ["en", "es"] and got[1] == ["en"] and got[2] == ["fr"] and set(got[8]) == {"en"} and got[5] == ["en"]
    assert set(got) - {7} == {0, 1, 2, 5, 8}  # whatever has a word has a language; nonsense may share a few letters with one
    passages = langid.unlabelled_languages(langid.segment_languages(df.withColumn("label", F.lit("en")), model, ["id", "label"], F.col("text"), False), "id", F.col("label"))
    assert {tuple(r) for r in passages.collect()} == {(0, "es"), (2, "fr")}


def test_filter_has_no_false_negative():
    f = langid.build_filter([("en", "alpha beta gamma")] * 3 + [("de", "alpha zwei drei")] * 3, ("en", "de"), log2_cells=12, least=1)
    assert f.mask("=alpha") & 3 == 3 and f.mask("=beta") & 1 and f.mask("=zwei") & 2
    assert (f.wrong < 0.01).all()


def test_false_positives_are_taken_off():
    """In a small, crowded filter words that no language has show all of them; the correction leaves about nothing, and little is lost of words that are there."""
    rng = random.Random(5)
    made = lambda letters, n: ["".join(rng.choice(letters) for _ in range(7)) for _ in range(n)]
    known = made("abcdefgh", 60)
    f = langid.build_filter([("en", " ".join(known))] * 3 + [("de", "zwei")] * 3, ("en", "de"), log2_cells=10, hashes=2, least=1)
    assert f.wrong[0] > 0.3
    corrected = langid.WordScores(f).score(made("qrstuvwx", 400))[:, 0]
    f.wrong[:] = 0
    raw = langid.WordScores(f).score(made("qrstuvwx", 400))[:, 0]
    assert raw.mean() > 0.3 and corrected.mean() < 0.6 * raw.mean()
    assert langid.WordScores(f).score(known)[:, 0].min() == 1.0


def test_scores_do_not_depend_on_the_cache(model):
    words = ["the", "straße", "mañana", "c'est", "the", "x"] * 3
    a, b = langid.WordScores(model), langid.WordScores(model, most=1)
    for w in words:
        x, y = a.places([w]), b.places([w])
        assert (a.evidence[x] == b.evidence[y]).all()


def test_best_path_equals_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    e = rng.random((4, 5, 3))
    length = np.array([5, 3, 1, 4])
    path = langid.best_path(e, length, 0.4)
    for i, n in enumerate(length):
        value = lambda p: sum(e[i, k, p[k]] for k in range(n)) - 0.4 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert abs(value(path[i, :n]) - max(value(p) for p in itertools.product(range(3), repeat=int(n)))) < 1e-12


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("en-US",), ("en_GB",), ("Spanish",), ("xx",), (None,), ("",), (" pt_PT ",)], "l string")
    assert [r[0] for r in df.select(langid.label_language(F.col("l"))).collect()] == ["en", "en", "en", "es", "xx", None, "", "pt"]


def test_found_form(spark, folder):
    out = catalog.p3_found(spark, folder)
    assert out.columns == ["message_id", "lang"] and out.count() == out.distinct().count() > 0


# --- leaked items -----------------------------------------------------------

ITEM = "Seven people saw Urdis carry a late invoice out of Quellwater while the tram driver asked for nineteen tokens and waited three hours. At first Vannic felt grief yet by evening Urdis had sold the boat and told Irsa about the flood."
OTHER = "Nine people saw Irsa carry a cracked lantern out of Velbury while the ferry clerk asked for twelve tokens and waited five hours. At first Urdis felt envy yet by evening Vannic had hidden the key and told Urdis about the strike."
FILL = "I was going to write about the rent but I baked bread instead and then we talked about it for a while because nobody called back. "


def leaks(spark, docs, items=((1, ITEM), (2, OTHER)), **options):
    d = spark.createDataFrame(list(docs), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in leakage.find_leaks(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"), **options).collect()}


def test_leaks(spark):
    words = ITEM.split()
    rng = random.Random(1)
    altered = " ".join(rng.choice(["so", "week", "two"]) if i % 9 == 4 else w for i, w in enumerate(words))
    halves = " ".join(words[:22]) + " " + FILL + " ".join(words[22:])
    docs = [(1, FILL + ITEM + FILL), (2, FILL + altered), (3, halves), (4, FILL + " ".join(words[:12])), (5, FILL * 30), (6, FILL + " ".join(words[8:36]).upper()), (7, ""), (8, None), (None, ITEM), (9, ITEM), (9, ITEM), (10, "<p>" + ITEM.replace(" ", "&nbsp;") + "</p>"), (11, ITEM.replace("nineteen", "19").replace("Seven", "7"))]
    got = leaks(spark, docs)
    assert {k for k, r in got.items() if r.kind == "copy"} == {(d, 1) for d in (1, 2, 3, 6, 9, 10, 11)}
    assert got[3, 1].stretches == 2 and got[1, 1].share == 1.0


def pair(item, doc):
    coder = leakage.WordCodes(np.zeros(1 << 14, np.uint64))
    return leakage.match_pair(np.array(coder(item), np.uint64), np.array(coder(doc), np.uint64), leakage.Limits())


@pytest.mark.parametrize("n,first,gap,second", [(66, 20, 12, 20), (66, 25, 13, 22), (90, 30, 20, 30), (66, 18, 16, 17)])
@pytest.mark.parametrize("replaced", [True, False])
def test_two_stretches_around_a_gap(n, first, gap, second, replaced):
    """A gap shorter than the stretches around it, left out or replaced, doesn't lose the pair."""
    item = [f"w{k}a" for k in range(n)]
    other = [f"x{k}a" for k in range(gap)] if replaced else []
    doc = ["so", *item[:first], *other, *item[first + gap : first + gap + second], "then"]
    found = pair(item, doc)
    assert found[2:] == (2, "copy") and found[0] == (first + second) / n
    # a third stretch isn't counted
    thirds = [*item[: n // 5], *other, *item[2 * n // 5 : 3 * n // 5], *other, *item[4 * n // 5 :]]
    assert (pair(item, thirds) or "none")[-1] != "copy"


def test_recall_from_half_of_an_item(spark):
    """Whatever holds 50 to 70 % of an item in one or two stretches, lightly altered or not, is found; less is not."""
    rng = random.Random(3)
    items = {i: [f"w{i}x{k}" if k % 3 else rng.choice(FILL.split()) for k in range(rng.randint(24, 70))] for i in range(12)}
    docs, want = [], set()
    for d in range(150):
        i = rng.randrange(12)
        item = items[i]
        share = rng.choice([0.3, 0.55, 0.6, 0.7])
        n = int(share * len(item)) + 1
        cut = n // 2 if rng.random() < 0.5 and n >= 16 else n
        at = rng.randint(0, len(item) - n)
        skipped = rng.randint(0, len(item) - n - at)
        words = item[at : at + cut] + FILL.split()[:20] * (cut < n) + item[at + cut + skipped * (cut < n) :][: n - cut]
        if share == 0.7 and cut == n:
            words[len(words) // 2] = "other"
        docs.append((d, FILL + " ".join(words) + " " + FILL))
        if share > 0.5:
            want.add((d, i))
    got = {k for k, r in leaks(spark, docs, items=[(i, " ".join(w)) for i, w in items.items()]).items() if r.kind == "copy"}
    assert got == want


def test_recall_of_variants(spark):
    """Questions with other names, numbers and units in the same template are found as variants."""
    rng = random.Random(8)
    names = "Irsa Urdis Vannic Quellwater Velbury Dunmere Osk".split()

    def made(k):
        a, b, c = rng.sample(names, 3)
        n, m, h = (rng.choice("three four seven nine twelve nineteen forty".split()) for _ in range(3))
        return f"On day {k} the clerk {a} sold q{k}a {n} boats to his friend {b} for q{k}b {m} {rng.choice(['dollars', 'euros', 'cents'])} each, and {c} rowed q{k}c home in {h} {rng.choice(['hours', 'minutes'])}. How much did q{k}d earn that day?"

    items = [(k, made(k)) for k in range(40)]
    docs = [(k, FILL + made(k) + " " + FILL) for k in range(40)]
    got = leaks(spark, docs, items=items)
    assert len({d for (d, i) in got if d == i}) >= 36


def test_short_items_and_common_phrases(spark):
    """Items under a window are found whole; a phrase that all items share brings no pair and hides none."""
    phrase = "read the following passage and then answer the question below"
    items = [(1, "quellwater tram"), (2, "Irsa"), *[(10 + k, f"{phrase} " + " ".join(f"t{k}w{j}" for j in range(40))) for k in range(30)]]
    docs = [(1, "we took the Quellwater tram home"), (2, "quellwater has a tram"), (3, f"{phrase} t5w0"), (4, items[7][1]), (5, "irsa")]
    got = leaks(spark, docs, items=items)
    assert {k for k, r in got.items() if r.kind == "copy"} == {(1, 1), (4, 15), (5, 2)}


def test_variants_are_no_copies(spark):
    got = leaks(spark, [(1, FILL + OTHER)], items=((1, ITEM),))
    assert not any(r.kind == "copy" for r in got.values())


def test_no_items_or_documents(spark):
    assert leaks(spark, [(1, ITEM)], items=((1, None),)) == {}
    assert leaks(spark, [(1, None)]) == {}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=14), st.lists(st.integers(0, 4), min_size=1, max_size=14))
def test_alignment_score(a, b):
    """Equal to the plain recursion of local alignment."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (1 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    score, at, bt = leakage.align(np.array(a), np.array(b))
    assert score == max(map(max, h)) and len(at) == len(bt)
    assert all(x < y for x, y in zip(at, at[1:])) and all(x < y for x, y in zip(bt, bt[1:]))


def test_recall_against_brute_force(spark):
    """Every pair that a word-by-word comparison of all documents with all items finds at 70 % is found."""
    folder = "/root/testdata/sf0.001"
    d, e = table(spark, folder, "documents").where("text is not null").collect(), table(spark, folder, "eval_items").collect()
    items = {r.item_id: leakage.words_of(r.text) for r in e}
    want = set()
    for r in d:
        words = leakage.words_of(r.text)
        have = Counter(words)
        for i, w in items.items():
            if sum((have & Counter(w)).values()) >= 0.7 * len(w):
                m = difflib.SequenceMatcher(None, w, words, autojunk=False)
                if sum(b.size for b in m.get_matching_blocks() if b.size >= 4) >= 0.7 * len(w):
                    want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in catalog.p9_found(spark, folder).collect()}
    assert want <= got


# --- packing ----------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 64))
def test_pack_is_valid(sizes, capacity):
    s = np.array(sizes, np.int64)
    for how in (packing.sum_of_squares, packing.tightest_fit):
        at = how(s, capacity)
        fill = Counter()
        for c, x in zip(at, s):
            fill[int(c)] += int(x)
        assert len(at) == len(s) and all(v <= capacity for v in fill.values())


def test_sum_of_squares_rule():
    """Each placement makes the sum of squares of partly filled levels least."""
    rng = np.random.default_rng(0)
    sizes, capacity = rng.integers(1, 10, 300), 10
    at = packing.sum_of_squares(sizes, capacity)
    fill: dict = {}
    for c, s in zip(at, sizes):
        counts = Counter(v for v in fill.values() if v < capacity)
        ss = lambda k: sum(v * v for lv, v in k.items() if 0 < lv < capacity)

        def after(level, s=s, counts=counts, ss=ss):
            k = counts.copy()
            if level:
                k[level] -= 1
            k[level + s] += 1
            return ss(k)

        options = {lv: after(lv) for lv in [0, *counts] if lv + s <= capacity}
        assert options[fill.get(c, 0)] == min(options.values())
        fill[c] = fill.get(c, 0) + s


def test_pack_documents(spark):
    rng = np.random.default_rng(2)
    data = [(i, int(rng.integers(1, 90))) for i in range(400)] + [(900, 0), (901, None), (902, 500), (903, 128)]
    sizes = spark.createDataFrame(data, "doc_id long, tokens long").withColumns({"packer": F.lit("x"), "capacity": F.lit(1)})
    targets = spark.createDataFrame([(1, 64, "a"), (2, 128, "b"), (3, None, "c"), (4, 0, "d")], "target_id int, capacity_tokens int, purpose string")
    made = packing.pack_documents(sizes, targets, per_packer=150).cache()
    assert {(r.target_id, r.n_documents, r.over_capacity, r.wrong_documents) for r in packing.check_packing(made, sizes, targets.where("capacity_tokens > 0")).collect()} == {(1, 402, 0, 0), (2, 402, 0, 0)}
    broken = made.where("doc_id <> 5").unionByName(made.where("doc_id = 6").withColumn("first_token", F.lit(0).cast("long")))
    assert all(r.wrong_documents == 2 for r in packing.check_packing(broken, sizes, targets.where("capacity_tokens > 0")).collect())
    pieces = made.collect()
    for t, cap in ((1, 64), (2, 128)):
        mine = [p for p in pieces if p.target_id == t]
        fill, docs = Counter(), {}
        for p in mine:
            fill[p.container] += p.tokens
            docs.setdefault(p.doc_id, []).append((p.first_token, p.tokens))
        assert max(fill.values()) <= cap
        for d, n in data:
            if n:
                at = 0
                for first, k in sorted(docs[d]):
                    assert first == at
                    at += k
                assert at == n and (len(docs[d]) == 1 or n > cap)
        assert 900 not in docs and 901 not in docs
        assert sum(fill.values()) / (cap * len(fill)) > 0.9
    assert {p.target_id for p in pieces} == {1, 2}
    assert packing.pack_documents(sizes.limit(0), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (None, "x")], "doc_id long, text string")
    assert packing.token_counts(df, F.col("doc_id"), F.col("text"), catalog.RANKS_FILE).count() == 4
    n = {r.doc_id: r.tokens for r in packing.token_counts(df, F.col("doc_id"), F.col("text"), catalog.RANKS_FILE).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1


# --- cut texts --------------------------------------------------------------


@pytest.mark.parametrize(
    "text,core", [("I said so… #tag https://lnk.example/a", "I said so"), ("it was. ☀️", "it was."), ("abc [truncated]", "abc"), ("so &am", "so"), ("so <b", "so"), ("done.\n-- Kelvo", "done."), ("Well :-(", "Well"), ("<3", "")]
)
def test_core(text, core):
    assert truncation.core_of(text) == core


SENTENCES = [f"{who} asked about the {what} {when}." for who in ("My sister", "The coach", "Our lead") for what in ("rent", "dog", "choir", "garden") for when in ("before lunch", "all week", "last night", "on the way home")]


def corpus(rng, n):
    return [" ".join(rng.choice(SENTENCES) for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_cut_texts(spark):
    rng = random.Random(3)
    texts = corpus(rng, 300)
    cut, whole = [], []
    data = []
    for i, t in enumerate(texts):
        kind = i % 5
        if kind == 0:
            w = t.split()
            end = next(k for k in range(len(w) - 3, 0, -1) if not w[k - 1].endswith(".") and w[k - 1] not in ("lunch", "week", "night", "home", "rent", "dog", "choir", "garden"))
            data.append((i, " ".join(w[:end]) + rng.choice(["", "…", " #tag", "..."])))
            cut.append(i)
        elif kind == 1:
            data.append((i, t[:-1] + rng.choice(["", " #tag", "…", " https://lnk.example/q"])))
            whole.append(i)
        else:
            data.append((i, t))
            whole.append(i)
    data += [(1000, ""), (1001, None), (1002, "…"), (1003, "   "), (1004, "hm"), (None, "no id")]
    df = spark.createDataFrame([(i, t, f"s{i % 3}" if i and i % 7 else None) for i, t in data], "doc_id long, text string, source string").withColumns({"ends": F.lit(0), "ctx": F.lit(1), "n_chars": F.lit("x")})
    got = {r.doc_id: r for r in truncation.judge_texts(df, F.col("doc_id"), F.col("text"), F.col("source")).collect()}
    assert set(got) >= set(cut) | set(whole) and not {1000, 1001, 1003} & set(got)
    repeated = truncation.judge_texts(df.unionByName(df.where("doc_id < 50")), F.col("doc_id"), F.col("text"), F.col("source"))
    assert repeated.count() == len(got) + 50 and repeated.where("cut").select("doc_id").distinct().count() >= len(cut) - 3
    found = {d for d, r in got.items() if r.cut and d < 1000}
    assert len(found & set(cut)) >= 0.97 * len(cut) and len(found - set(cut)) <= 0.02 * len(whole)
    shares = {r.source: r for r in truncation.cut_shares(truncation.judge_texts(df, F.col("doc_id"), F.col("text"), F.col("source"))).collect()}
    assert sum(r.n_cut for r in shares.values()) == sum(r.cut for r in got.values())
    assert truncation.judge_texts(df.limit(0), F.col("doc_id"), F.col("text"), F.col("source")).count() == 0


def evidence(df):
    """doc_id: ends, of copy_evidence."""
    rows = truncation.text_rows(df, F.col("doc_id"), F.col("text"), F.lit("s")).cache()
    closing = truncation.closing_contexts(rows).dropDuplicates(["uid"]).cache()
    every = np.full(1 << 12, np.iinfo(np.uint64).max, np.uint64)
    found = truncation.copy_evidence(rows.select("uid", "text"), closing, truncation.scan_texts(rows, every, every).cache())
    return {r.doc_id: r.ends for r in rows.join(found, "uid").collect()}


@pytest.mark.parametrize("kept", [0.95, 0.8, 0.7, 0.6, 0.5, 0.25])
def test_copies_of_any_length_are_found(spark, kept):
    """Recall against brute force (each text is contained in exactly one other), a few words altered or not."""
    rng = random.Random(int(kept * 100))
    data = []
    for i in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        cut = words[: int(200 * kept)]
        if i % 2:
            cut[len(cut) // 2] = "other"
        data += [(2 * i, " ".join(cut)), (2 * i + 1, " ".join(words) + ".")]
    got = evidence(spark.createDataFrame(data, "doc_id long, text string"))
    assert len([d for d, e in got.items() if e == "inside" and d % 2 == 0]) >= 19


def test_copies_decide(spark):
    """A near-copy that goes on shows where a text was cut."""
    base = " ".join(SENTENCES[:10])
    long = base + " The coach asked about the rent all week and then went home to sleep."
    cut = base + " The coach asked about the rent all week"
    short = base[:-1]
    df = spark.createDataFrame([(1, long), (2, cut), (3, short), (4, long)], "doc_id long, text string")
    got = evidence(df)
    assert got == {2: "inside", 3: "between"}
    appended = spark.createDataFrame([(1, short), (2, short + " #tag #more #words")], "doc_id long, text string")
    assert set(evidence(appended).values()) <= {"between"}


def test_copies_in_hot_groups(spark):
    """A near-copy is found though its buckets hold many longer texts that are too long to be near-copies, and exact copies."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    data, want = [], {}
    for g in range(12):
        base = [word() for _ in range(100)]
        marked = [*base[:89], base[89] + ".", *base[90:]] if g % 2 else base
        own = [" ".join(marked) + " " + " ".join(word() for _ in range(40)) + "." for _ in range(20)]
        data += [(1000 * g, " ".join(base[:90])), (1000 * g + 1, " ".join(marked) + ".")]
        data += [(1000 * g + 2 + k, t) for k, t in enumerate(own * 2)]
        data += [(1000 * g + 100, " ".join(base[:90]))]
        want |= {1000 * g: "between" if g % 2 else "inside", 1000 * g + 100: "between" if g % 2 else "inside"}
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = evidence(df)
    assert got == want


def test_copy_cut_at_the_same_place_shows_nothing(spark):
    """Two texts cut at one place, with other things appended, don't show each other whole; a third that goes on shows both."""
    cut = " ".join(SENTENCES[:10]) + " The coach asked about the"
    df = spark.createDataFrame([(1, cut), (2, cut + " #tag #more #words"), (3, cut + " rent all week.")], "doc_id long, text string")
    got = evidence(df)
    assert got[1] == "inside"
    judged = truncation.judge_texts(df.where("doc_id < 3").withColumn("source", F.lit("s")), F.col("doc_id"), F.col("text"), F.col("source"))
    assert {r.doc_id for r in judged.where("cut").collect()} == {1, 2}


def test_copies_that_go_on_flag_by_themselves(spark):
    """Closing words that usually end a sentence don't hide a cut that a longer copy shows, in mid-sentence or mid-word; without marks the words decide."""
    rng = random.Random(9)
    filler = [" ".join(f"v{rng.randrange(50)}" for _ in range(6)) + end for end in (" We talked for a while and then went home.", " We talked for a while and sat in the car.") for _ in range(30)]
    bases = [" ".join(f"u{i}k{k}" + ("." if k % 10 == 9 else "") for k in range(60)) for i in range(3)]
    plain = bases[2].replace(".", "")
    texts = [bases[0] + " We talked for a while and then went home", bases[0] + " We talked for a while and then went home early today.", bases[1] + " We talked for a while and sat in the car", bases[1] + " We talked for a while and sat in the carriage.", plain + " we talked for a while and then went home", plain + " we talked for a while and then went home early today"]
    df = spark.createDataFrame(list(enumerate(texts + filler)), "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in truncation.judge_texts(df, F.col("doc_id"), F.col("text"), F.col("source")).collect()}
    assert [got[i].ends for i in (0, 2, 4)] == ["inside"] * 3 and min(got[i].terminality for i in (0, 2, 4)) > truncation.CUT_BELOW_LIKELY
    assert [got[i].cut for i in (0, 1, 2, 3, 4)] == [True, False, True, False, False]


def test_length_limits(spark):
    """Limits of small sources, beside longer texts, several to a source, and of texts to which something was appended; copies and common lengths are none."""
    rng = random.Random(4)
    data, want = [], set()

    def add(source, text, limit=False):
        data.append((len(data), text, source))
        if limit:
            want.add(len(data) - 1)

    def open_text(n, tag=""):
        return ("".join(rng.choice("abcdefgh ") for _ in range(n - 1)) + "x") + tag

    for _ in range(6):
        add("small", open_text(160), True)
    for k in range(30):
        add("small", open_text(40 + 3 * k))
        add("other", open_text(40 + k % 7))
        add("other", open_text(400) if k % 5 == 0 else open_text(300 + k), k % 5 == 0)
    add("small", open_text(900))
    add("small", open_text(160, " #tag"), True)
    add("small", open_text(160, "…"), True)
    copy = open_text(777)
    for _ in range(12):
        add("other", copy)
    for _ in range(8):
        add("twice", open_text(280), True)
        add("twice", open_text(500), True)
        add("appended", open_text(200, rng.choice(["…", " #tag", " https://lnk.example/" + "q" * rng.randint(1, 30)])), True)
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = truncation.judge_texts(df, F.col("doc_id"), F.col("text"), F.col("source"))
    found = {r.doc_id for r in got.where("at_limit").collect()}
    assert found == want


def test_start_signatures_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n).astype(np.uint64) for n in (0, 1, 7, 40, 0, 3, 12)]
    key, text, size = truncation.start_signatures(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert [(t, s) for t, s in zip(text, size)] == [(i, s) for i, t in enumerate(texts) if len(t) for s in truncation.sizes_upto(len(t))]
    for k, t, s in zip(key, text, size):
        low = (texts[t][:s, None] * truncation._MULT + truncation._ADD).min(axis=0).reshape(truncation.BANDS, truncation.ROWS)
        for band in range(truncation.BANDS):
            want = np.uint64(s) * truncation._MIX + np.uint64(band)
            for r in range(truncation.ROWS):
                want = (want ^ low[band, r]) * truncation._MIX
                want ^= want >> np.uint64(29)
            assert k[band] == want
    assert len(truncation.start_signatures(np.zeros(0, np.uint64), np.zeros(3, int))[0]) == 0


def test_counts_of_contexts(spark):
    df = spark.createDataFrame([(1, "a b c. a b d"), (2, "x a b. y"), (3, "c. a")], "uid long, text string")
    hasher = truncation.Hasher()
    h = truncation.contexts(hasher(["a", "b"]))[1][-1]
    every = np.full(1 << 12, np.iinfo(np.uint64).max, np.uint64)
    got = {r.h: (r.n, r.e) for r in truncation.context_counts(truncation.scan_texts(df, every, every)).collect()}
    assert got[int(h.view(np.int64))] == (3, 1)
