"""Column functions against worked values and plain Python."""

import datetime

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C
from tallyloom.functions import keys as K
from tallyloom.functions import numeric as N
from tallyloom.functions import text as X

SENTENCES = [
    "RT @ #tagcoding: this is a typical post :-)",
    "phone numbers like +1 (800) 123-4567, (800) 123-4567, and 123-4567 are tokens",
    "Something </sarcasm> about <fails to break this up> <3 </3 <\\3 mañana vergüenza <em class=\"grumpy\">pain</em> <br />",
    "with a url: http://www.example.com/watch?v=dQw4w9WgXcQ, example.com https://example.org/ ",
    "can't stop... 8pm 3,500 x-ray [command] ok_go >:(",
    "",
    "日本 text, ¿qué? don't",
]


def values(spark, data, kinds, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, kinds).select(*cols).collect()]


def test_tokens_equal_python_regex(spark):
    pattern = regex.compile(X.TOKEN)
    emoticon = regex.compile("(?i)" + X.EMOTICON)
    got = values(spark, [(s,) for s in SENTENCES], "t string", X.tokens(F.col("t")))
    for s, (tokens,) in zip(SENTENCES, got):
        assert tokens == [t if emoticon.search(t) else t.lower() for t in pattern.findall(s)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab @#<>:;=3()-_.,/x8'" + '"', max_size=25), min_size=5, max_size=20))
def test_tokens_property(spark, texts):
    pattern = regex.compile(X.TOKEN)
    got = values(spark, list(enumerate(texts)), "i int, t string", "i", F.transform(X.tokens(F.col("t")), F.lower))
    for i, tokens in got:
        assert tokens == [t.lower() for t in pattern.findall(texts[i])]


def test_null_text_everywhere(spark):
    c = F.col("t")
    row = values(spark, [(None,)], "t string", X.tokens(c), X.anonymize(c), X.shrink_space(c), X.split_shared(c), X.decode_entities(c), X.not_shared(c), X.without_link(c), X.ngrams(X.tokens(c), 2), X.duplicate_key(c))[0]
    assert row == (None, None, None, None, None, False, False, [], None)


def test_anonymize_worked_values(spark):
    data = [("hi @bob see http://a.com now",), ("go a.com now",), ("plain",)]
    assert values(spark, data, "t string", X.anonymize(F.col("t"))) == [("hi <USER> see <URL> now",), ("go <URL>now",), ("plain",)]


@pytest.mark.parametrize("text,keep", [("RT me", False), ("RTme", True), ("see http://x.y/z", False), ("bla.com.", False), ("no link.here", True), ("www.abc", False), ("about.company", True)])
def test_filters(spark, text, keep):
    assert values(spark, [(text,)], "t string", X.not_shared(F.col("t")) & X.without_link(F.col("t"))) == [(keep,)]


def test_ngrams_and_whitelist(spark):
    df = spark.createDataFrame([(["I", "like", "it"], ["I", "like"]), (["a"], [])], "t array<string>, w array<string>")
    got = df.select(X.ngrams(F.col("t"), 2).alias("g"), X.whitelisted_ngrams(F.col("t"), 2, F.col("w")).alias("w")).collect()
    assert got[0].g == ["I like", "like it"] and got[0].w == ["I like", "<OOV_2gram>"]
    assert got[1].g == [] and got[1].w == []


def test_duplicate_key_rules(spark):
    data = [
        ("one two three four five six seven",),
        ("One two three",),
        ("#tag @user one it's two",),
        ("My YouTube one two three four five",),
        ("3rd a bb",),
        ("my page <img width=300> loads slow today again now",),
        ("one =-3 =3) two three four five six",),
    ]
    got = [r[0] for r in values(spark, data, "t string", X.duplicate_key(F.col("t"), "youtube"))]
    assert got == ["one two three four five six", "one two three", "<user> one two", "my youtube one two three", "bb", "my page <img width=300> loads slow today", "one two three four five six"]


def test_shared_parts(spark):
    data = [("so true RT @ann: big news",), ("RT @ann: big news",), ("big news (via @ann) wow",), ("big news via @ann",), ("nothing here",), ("(via @ann) no brackets",), ("(via @ann) news [my view]",)]
    got = [(r[0].shared, r[0].comment) for r in values(spark, data, "t string", X.split_shared(F.col("t")))]
    assert got == [("big news", "so true"), ("big news", ""), ("big news", "wow"), ("big news", ""), ("", ""), ("", ""), ("news", "my view")]


def test_entities():
    assert X.decode_entities_text("a &amp; b") == "a &amp; b"
    assert X.decode_entities_text("a &amp; &eacute;") == "a  and  é"
    assert X.decode_entities_text("&#39;x&#99999999;") == "'x&#99999999;"


def test_space(spark):
    assert values(spark, [("  a   b\n\nc......d \n",)], "t string", X.shrink_space(F.col("t"))) == [("a b c....d",)]
    assert values(spark, [("a\nb",)], "t string", X.mark_newlines(F.col("t"))) == [("a <NEWLINE> b",)]


def test_special_tokenizers(spark):
    assert values(spark, [("big/JJ and/or/CC",)], "t string", X.pos_tokens(F.col("t"))) == [(["JJ", "CC"],)]
    text = "[nsubj(likes-2, she-1), dobj(likes-2, tea-3)]"
    assert values(spark, [(text,)], "t string", X.dependency_tokens(F.col("t")), X.dependency_tokens(F.col("t"), True)) == [(["nsubj likes she", "dobj likes tea"], ["nsubj", "dobj"])]


def test_keys_worked_values(spark):
    c = [F.col("a"), F.col("b"), F.col("c")]
    data = [("2020-02-24 10:00:00", None, None, "7"), ("2019-12-30 00:00:00", None, None, "7"), ("x", "2020-02-24 10:00:00", None, "7"), ("x", "y", None, "7"), ("2020-02-24 10:00:00", None, None, None)]
    kind = "a string, b string, c string, u string"
    assert [r[0] for r in values(spark, data, kind, K.message_group(c, F.col("u")))] == ["2020_09:7", "2020_01:7", "2020_09:7", ":7", ""]
    assert values(spark, data[1:2], kind, K.message_group(c, F.col("u"), "mixed")) == [("2019_01:7",)]
    monday = datetime.date(2020, 2, 24)
    week = values(spark, [("2020_09",), ("bad",)], "w string", K.week_days(F.col("w")))
    assert week[0][0] == (monday, monday + datetime.timedelta(3), monday + datetime.timedelta(6)) and week[1][0].monday is None
    got = values(spark, [("2020_09:7", "01003"), ("2020_09", "01003"), (":7", "01003")], "g string, c string", K.week_county(F.col("g"), F.col("c")), K.month_county(F.col("g"), F.col("c")), K.year_county(F.col("g"), F.col("c")))
    assert got == [("2020_09:01003", "2020_02:01003", "2020:01003"), (None, None, None), (None, None, None)]


def test_unpadded_weeks(spark):
    days = ["2020-01-01", "2020-01-05", "2019-12-28", "2019-12-29", "2020-02-24"]
    got = values(spark, [(d,) for d in days], "d string", K.dated_group(F.lit("g"), F.col("d"), r"^(\d{4}-\d{2}-\d{2})"))
    assert [r[0] for r in got] == ["2020_1:g", "2020_2:g", "2019_52:g", "2019_1:g", "2020_9:g"]
    assert values(spark, [("none",), ("9999-99-99",)], "d string", K.dated_group(F.lit("g"), F.col("d"), r"^(\d{4}-\d{2}-\d{2})")) == [(None,), ("g",)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.dates(datetime.date(1990, 1, 1), datetime.date(2060, 12, 31)), min_size=20, max_size=60))
def test_iso_weeks_property(spark, days):
    got = values(spark, [(d,) for d in days], "d date", "d", K.iso_week(F.col("d")), K.week_monday(K.iso_week(F.col("d"))))
    for d, week, monday in got:
        y, w, _ = d.isocalendar()
        assert week == f"{y:04d}_{w:02d}" and monday == d - datetime.timedelta(d.weekday())


def test_cleaning(spark):
    c = F.col("t")
    data = [(' "1003" ',), ("-1",), ("",), (None,), ("123456",), ('" "',)]
    assert [r[0] for r in values(spark, data, "t string", C.clean_county(c))] == ["01003", None, None, None, "123456", None]
    ids = [('"2020_7:5"',), (":5",), ("2020_07:5 ",), (None,), ("  ",)]
    assert [tuple(r) for r in values(spark, ids, "t string", C.clean_group_id(c), C.group_week(C.clean_group_id(c)), C.group_entity(C.clean_group_id(c)))] == [
        ("2020_07:5", "2020_07", "5"), (":5", None, "5"), ("2020_07:5", "2020_07", "5"), (None, None, None), (None, None, None)]
    assert [r[0] for r in values(spark, [(' "1.5"',), ("abc",), (None,)], "t string", C.clean_number(c))] == [1.5, 0.0, 0.0]
    x = [(0.5,), (1.0,), (0.0,), (1.1,), (float("nan"),), (float("inf"),), (None,)]
    assert [r[0] for r in values(spark, x, "t double", C.plausible_share(c))] == [True, True, False, False, False, False, False]


def test_numeric(spark):
    c = F.col("x")
    assert [round(r[0], 6) for r in values(spark, [(2.0,), (3.0,), (None,)], "x double", N.anscombe(c))] == [3.082207, 3.674235, 0.0]
    assert [r[0] for r in values(spark, [(-0.2,), (2.5,), (7.0,), (None,)], "x double", N.clamp(c))] == [0.0, 2.5, 5.0, None]
    assert [r[0] for r in values(spark, [(9999.99,), (10000.0,), (200000.0,), (None,), (float("nan"),)], "x double", N.income_bin(c))] == [1, 2, 10, None, None]
    assert [r[0] for r in values(spark, [(0.0,), (1.0,), (2.0,), (2.1,), (-1.0,)], "x double", N.histogram_bin(c, [0, 1, 2]))] == [0, 1, 1, None, None]
    assert values(spark, [(1.0,)], "x double", N.min_max(c, F.lit(1.0), F.lit(1.0))) == [(2.5,)]
