"""The stages put together: messages to scored places. What a stage uses more than once is written before, so that the messages are read and tokenized once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import features as FT
from tallyloom.operators import geo, lexicon, messages, ngrams
from tallyloom.storage import materialize


@dataclass(frozen=True)
class Settings:
    """What may differ between runs; the defaults follow the documented order of steps."""

    message: str = "message"
    user: str = "user_id"
    dates: tuple[str, ...] = ("created_at", "date2", "date3")
    order: tuple[str, ...] = ("message_id",)
    languages: tuple[str, ...] | None = ("en",)
    least_confidence: float = 0.0
    least_posts: int = 3
    anonymize: bool = True
    year_range: tuple[str, str] | None = None
    lexicon_only: bool = False
    categories: tuple[str, ...] | None = None
    bounds: tuple[float, float] = (0.0, 5.0)
    grain: str = "week"
    least_users: int = 1
    week_mode: str = "iso"
    extra: dict = field(default_factory=dict)


def prepare(raw: DataFrame, s: Settings) -> DataFrame:
    """Clean, keyed messages of users with enough posts in the week."""
    rows = messages.filter_language(raw, s.message, s.languages, s.least_confidence) if s.languages else raw
    rows = messages.clean_messages(rows, s.message, s.user, list(s.order), anonymize=s.anonymize)
    keyed = messages.key_messages(rows, s.user, list(s.dates), s.week_mode)
    return messages.with_min_posts(materialize(keyed, "keyed"), "group_id", s.least_posts) if s.least_posts > 1 else keyed.where(F.col("group_id").isNotNull())


def extract(prepared: DataFrame, weights: DataFrame, s: Settings) -> DataFrame:
    """The Anscombe-transformed feature table; with ``lexicon_only`` shares are those of the lexicon's words alone."""
    grams = ngrams.extract_ngrams(prepared, "group_id", s.message, norm=False)
    if s.lexicon_only:
        grams = FT.filter_vocabulary(grams, lexicon.vocabulary(weights))
    grams = materialize(grams, "ngrams")
    return FT.merge_repeated(FT.anscombe_rebase(grams, s.year_range, strip=False))


def score(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores as feature table."""
    return lexicon.score(features, weights).select("group_id", F.col("category").alias("feat"), "value", F.col("score").alias("group_norm"))


def place(scores: DataFrame, counties: DataFrame, group_weights: DataFrame, s: Settings) -> DataFrame:
    """The table of places and times."""
    located = geo.add_weight(geo.add_county(scores, counties), group_weights)
    clamped = FT.clamp_scores(located.where("value > 0"), low=s.bounds[0], high=s.bounds[1], categories=s.categories)
    return geo.with_min_users(geo.aggregate_places(clamped, s.grain), s.least_users)


def run(raw: DataFrame, lexicon_table: DataFrame, user_county: DataFrame, group_weight: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Messages to places and times."""
    s = settings or Settings()
    weights = lexicon.last_weights(lexicon_table)
    scored = score(extract(prepare(raw, s), weights, s), weights)
    return place(scored, geo.user_counties(user_county), geo.group_weights(group_weight), s)
