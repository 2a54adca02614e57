"""Message tables: cleaning, duplicates, languages, keys and posting thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions import text as X
from tallyloom.functions.cleaning import blank_to_null

#: Frequent short words by language, enough to tell these languages apart in whole sentences.
STOP_WORDS = {
    "en": "the and of to in is that it was for on you with this but not are we my i a so be can what about how".split(),
    "es": "el la los las de que y en un una por con no se me mi para más pero como esta muy lo al".split(),
    "fr": "le la les des de et en un une que qui pas je ne ce est pour dans sur plus mon ma nous vous on".split(),
    "de": "der die das und ich nicht ist ein eine zu mit den dem auf mir es wir sich auch wie noch nur".split(),
    "pt": "o a os as de que e em um uma não eu com por para mais mas como muito meu minha é do da isso".split(),
}


def by_name_or_index(df: DataFrame, column: str | int) -> Column:
    """A column named by name or by its place from 0."""
    return F.col(f"`{df.columns[column]}`") if isinstance(column, int) else F.col(column)


def drop_incomplete(df: DataFrame, message: str | int, group: str | int) -> DataFrame:
    """Without rows that are null in message or group, or whose message is the header word."""
    m, g = by_name_or_index(df, message), by_name_or_index(df, group)
    return df.where(m.isNotNull() & g.isNotNull() & (m != "message"))


def drop_duplicates(df: DataFrame, group: str, message: str, order: Sequence[str], key: Column | None = None) -> DataFrame:
    """One row for each (group, duplicate key): the first by ``order``.

    Rows are reduced by a partial aggregate of their order before they are
    shuffled, so many copies of one message don't gather in a task. Null groups
    are dropped; messages without any key word are duplicates of each other; of rows that tie in ``order`` one
    is kept. Only the columns of df come back.
    """
    keyed = df.where(F.col(group).isNotNull() & F.col(message).isNotNull()).withColumn("_key", X.duplicate_key(F.col(message)) if key is None else key)
    names = df.columns
    least = F.min_by(F.struct(*names), F.struct(*order)).alias("_row")
    return keyed.groupBy(group, "_key").agg(least).select("_row.*")


def clean_messages(df: DataFrame, message: str, group: str, order: Sequence[str], anonymize: bool = False, filter_first: bool = True) -> DataFrame:
    """Without incomplete rows, shared messages, messages with links and duplicates within the group; stray quotes around messages removed.

    ``filter_first`` filters before duplicates are dropped, so that a clean copy
    isn't lost to one that is filtered; the other order is the historical one.
    """
    df = drop_incomplete(df, message, group).withColumns({message: X.strip_quote_pair(F.col(message)), group: X.strip_quote_pair(F.col(group))})
    keep = X.not_shared(F.col(message)) & X.without_link(F.col(message))
    df = drop_duplicates(df.where(keep), group, message, order) if filter_first else drop_duplicates(df, group, message, order).where(keep)
    return df.withColumn(message, X.anonymize(F.col(message))) if anonymize else df


def stop_word_language(text: Column, words: Mapping[str, Sequence[str]] = STOP_WORDS) -> Column:
    """struct (lang, confidence): the language with most stop words and its share of all stop words found; both null if there are none. Ties go to the first name."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}']+"), 0)

    def judge(t: Column) -> Column:
        hits = F.array(*[F.struct(F.size(F.filter(t, lambda w: w.isin(*s))).alias("n"), F.lit(l).alias("lang")) for l, s in sorted(words.items())])  # noqa: B023
        best = F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("total")), lambda acc, h: F.struct(F.greatest(acc["n"], h["n"]).alias("n"), F.when(h["n"] > acc["n"], h["lang"]).otherwise(acc["lang"]).alias("lang"), (acc["total"] + h["n"]).alias("total")))
        return F.transform(F.array(best), lambda b: F.struct(b["lang"].alias("lang"), F.round(b["n"] / F.nullif(b["total"], F.lit(0)), 8).alias("confidence")))[0]

    # bound to a variable, so that the words are found once a row
    return F.transform(F.array(found), judge)[0]


def plain_for_language(text: Column) -> Column:
    """Lower case without tags, user names and links."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?:#|@)\S+|https?://\S+|www\.\S+", " ")))


def filter_language(df: DataFrame, message: str, languages: Sequence[str] | None = None, threshold: float = 0.0, classify=stop_word_language) -> DataFrame:
    """Rows whose message is in one of ``languages`` (any if None) with a confidence above ``threshold``; adds lang and confidence.

    Entities are decoded first; blank messages and the text ``NULL`` are
    dropped, other fields that are ``NULL`` become null. ``classify`` may be any function from a text column to struct (lang, confidence).
    """
    df = df.withColumn("_m", F.trim(X.decode_entities(F.col(message)))).where((F.col("_m") != "") & (F.col("_m") != "NULL"))
    df = df.withColumn("_l", classify(plain_for_language(F.col("_m"))))
    keep = (F.col("_l.lang").isin(*languages) if languages else F.col("_l.lang").isNotNull()) & (F.col("_l.confidence") > threshold)
    kept = [c for c in df.columns if c not in ("_m", "_l", "lang", "confidence")]
    types = dict(df.dtypes)
    fields = [F.nullif(F.col(c), F.lit("NULL")).alias(c) if types[c] == "string" else F.col(c) for c in kept]
    return df.where(keep).select(*fields, F.col("_l.lang").alias("lang"), F.col("_l.confidence").alias("confidence"))


def key_messages(df: DataFrame, user: str, dates: Sequence[str], mode: str = "iso", name: str = "group_id") -> DataFrame:
    """Adds the ``week:user`` key as first column; rows without user (empty key) are dropped, rows without a date keep ``:user``."""
    keyed = df.withColumn(name, blank_to_null(K.message_group([F.col(d) for d in dates], F.col(user), mode))).where(F.col(name).isNotNull())
    return keyed.select(name, *[c for c in df.columns if c != name])


def with_min_posts(df: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Rows of groups with at least ``least`` rows.

    Groups are counted with a map-side combine and joined back; adaptive execution splits a group that holds a large part of all rows.
    """
    enough = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(group)
    return df.join(enough, group, "left_semi")


def posts_per_group(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_posts"))


def first_rows(df: DataFrame, per: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of every group by ``order``."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_i") <= n).drop("_i")
