"""Queries over the domain tables, one or more for each operator of the library, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import cleaning as C
from tallyloom.functions import keys as K
from tallyloom.functions import numeric as N
from tallyloom.functions import text as X
from tallyloom.operators import features as FT
from tallyloom.operators import geo, lexicon, messages, ngrams, stats, trends, weights
from tallyloom.plans import pipeline
from tallyloom.plans.tables import clean_features, table
from tallyloom.storage import materialize, result_path
from tallyloom.streaming import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, first to ten, so that sums that differ in their last bit round alike; -0.0 as 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(F.round(col, 10), 6) + 0.0).alias(name or c)


def distinct_messages(s: SparkSession, d: str) -> DataFrame:
    """messages without repeated rows."""
    return table(s, d, "messages").select("message_id", "user_id", "message", "created_at", "date2", "date3", "lang").distinct()


def keyed_messages(s: SparkSession, d: str) -> DataFrame:
    return messages.key_messages(distinct_messages(s, d).where("message is not null"), "user_id", ["created_at", "date2", "date3"])


def feature_table(s: SparkSession, d: str) -> DataFrame:
    """feat_1gram as feature table of distinct (group_id, feat): sums of its rows, plausible shares only."""
    f = clean_features(s, d).where(F.col("group_id").isNotNull() & F.col("term").isNotNull() & ~F.col("term").startswith("@"))
    ok = (F.col("feat_freq") > 0) & (F.col("feat_freq") <= 1) & ~F.isnan("feat_freq") & (F.col("feat_count") > 0) & ~F.isnan("feat_count")
    rows = f.where(ok).select("group_id", F.col("term").alias("feat"), F.col("feat_count").alias("value"), F.col("feat_freq").alias("group_norm"))
    return FT.merge_repeated(rows.distinct())


def stored_features(s: SparkSession, d: str) -> DataFrame:
    """The feature table written once, for steps that use it more than once."""
    return materialize(feature_table(s, d), "features")


def lexicon_weights(s: SparkSession, d: str) -> DataFrame:
    return lexicon.last_weights(table(s, d, "lexicon"))


def scores(s: SparkSession, d: str, intercept_only: bool = True) -> DataFrame:
    return lexicon.score(feature_table(s, d), lexicon_weights(s, d), intercept_only)


def score_features(s: SparkSession, d: str) -> DataFrame:
    """Scores as feature table with yw."""
    out = scores(s, d).select("group_id", F.col("category").alias("feat"), "value", F.col("score").alias("group_norm"))
    return out.withColumn("yw", F.substring_index("group_id", ":", 1))


def stored_scores(s: SparkSession, d: str) -> DataFrame:
    return materialize(score_features(s, d), "scores")


def placed_scores(s: SparkSession, d: str) -> DataFrame:
    """Clamped scores with county and weight."""
    located = geo.add_county(score_features(s, d), geo.user_counties(table(s, d, "user_county")))
    weighted = geo.add_weight(located, geo.group_weights(table(s, d, "group_weight")))
    return FT.clamp_scores(weighted.where("value > 0"))


def places(s: SparkSession, d: str, grain: str = "week") -> DataFrame:
    return geo.aggregate_places(placed_scores(s, d), grain)


def place_panel(s: SparkSession, d: str) -> DataFrame:
    """One row a county and week with the depression and anxiety scores and the county's dimensions."""
    wide = places(s, d).groupBy(F.col("Space").alias("cnty"), F.col("Time").alias("yw")).agg(
        F.max(F.when(F.col("feat") == "DEP_SCORE", F.col("wavg_score"))).alias("dep"),
        F.max(F.when(F.col("feat") == "ANX_SCORE", F.col("wavg_score"))).alias("anx"),
        F.max(F.when(F.col("feat") == "ANG_SCORE", F.col("wavg_score"))).alias("ang"),
        F.max("N_users").alias("n_users"),
    )
    dim = table(s, d, "county_dim").select(F.lpad(F.col("fips").cast("string"), 5, "0").alias("cnty"), "state_abbr", "region", "region_name", "division")
    return wide.join(dim, "cnty")


def stored_panel(s: SparkSession, d: str) -> DataFrame:
    return materialize(place_panel(s, d), "panel")


# --- messages ---------------------------------------------------------------
@query
def message_tokens(s, d):
    m = distinct_messages(s, d).where("message is not null")
    return m.select("message_id", F.posexplode(X.tokens(F.col("message"))).alias("place", "token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))


@query
def whitespace_tokens(s, d):
    m = distinct_messages(s, d).where("message is not null")
    return m.select(F.explode(X.whitespace_tokens(F.col("message"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def tagged_word_tokens(s, d):
    """Words tagged with their length class as ``word/TAG``; the tags are then the tokens."""
    m = distinct_messages(s, d).where("message is not null")
    tagged = F.array_join(F.transform(X.whitespace_tokens(F.col("message")), lambda w: F.concat(w, F.lit("/L"), F.least(F.length(w), F.lit(9)).cast("string"))), " ")
    return m.select(F.explode(X.pos_tokens(tagged)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def dependency_tokens(s, d):
    """County dimension written as dependency text ``state(region-1, division-2),…`` and read back."""
    c = table(s, d, "county_dim")
    text = F.concat(F.lit("["), F.col("state_abbr"), F.lit("("), F.col("region_name"), F.lit("-1, "), F.col("division_name"), F.lit("-2), in("), F.col("state_name"), F.lit("-3, "), F.col("state_abbr"), F.lit("-4)]"))
    return c.select(F.explode(X.dependency_tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def filter_shared_and_links(s, d):
    m = distinct_messages(s, d)
    return m.where(X.not_shared(F.col("message")) & X.without_link(F.col("message"))).select("message_id")


@query
def anonymized_messages(s, d):
    m = distinct_messages(s, d).where("message is not null")
    return m.select("message_id", X.anonymize(F.col("message")).alias("message"))


@query
def shared_parts(s, d):
    m = distinct_messages(s, d).where("message is not null")
    return m.select("message_id", F.inline(F.array(X.split_shared(F.col("message"))))).where("shared <> ''")


@query
def originals(s, d):
    m = distinct_messages(s, d)
    return m.where(X.strictly_original(F.col("message"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query
def shrunk_messages(s, d):
    m = distinct_messages(s, d).where("message is not null")
    return m.select("message_id", X.shrink_space(F.col("message")).alias("message"))


@query
def decoded_messages(s, d):
    m = distinct_messages(s, d).where("message is not null")
    return m.select("message_id", X.remove_hex(X.decode_entities(F.col("message"))).alias("message"))


@query
def duplicate_keys(s, d):
    m = distinct_messages(s, d).where("message is not null")
    return m.select("message_id", X.duplicate_key(F.col("message")).alias("key"))


@query
def deduplicated_messages(s, d):
    return messages.drop_duplicates(distinct_messages(s, d), "user_id", "message", ["message_id", "created_at"]).select("message_id", "user_id")


@query
def clean_messages(s, d):
    return messages.clean_messages(distinct_messages(s, d), "message", "user_id", ["message_id", "created_at"], anonymize=True).select("message_id", "user_id", "message")


@query
def language_filter(s, d):
    return messages.filter_language(distinct_messages(s, d), "message", ["en"], 0.8).select("message_id", "lang", "confidence")


@query
def any_language_filter(s, d):
    """Messages that are clearly in one language, whichever it is."""
    return messages.filter_language(distinct_messages(s, d), "message", None, 0.8).select("message_id", "lang", "confidence")


@query
def complete_rows(s, d):
    return table(s, d, "user_county").na.drop()


@query
def dependency_labels(s, d):
    c = table(s, d, "county_dim")
    text = F.concat(F.lit("["), F.col("state_abbr"), F.lit("("), F.col("region_name"), F.lit("-1, "), F.col("division_name"), F.lit("-2), in("), F.col("state_name"), F.lit("-3, "), F.col("state_abbr"), F.lit("-4)]"))
    return c.select(F.explode(X.dependency_tokens(text, label_only=True)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def posts_by_first_word(s, d):
    """A date with its time cut at the blank."""
    m = distinct_messages(s, d).where("created_at is not null")
    return m.select(K.first_word(F.col("created_at")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def cleaned_numbers(s, d):
    """What stands for a number where numbers are read from text; the rest counts as 0."""
    m = distinct_messages(s, d)
    return m.select("message_id", C.clean_number(F.col("user_id")).alias("number")).distinct()


@query
def first_messages_of_users(s, d):
    """The first two messages of every user."""
    m = distinct_messages(s, d).where("user_id is not null and message_id is not null").select("user_id", "message_id").distinct()
    return messages.first_rows(m, ["user_id"], ["message_id"], 2)


@query
def counties_in_order(s, d):
    """The county dimension sorted by its index, with each row's place."""
    c = table(s, d, "county_dim").orderBy("fips")
    return c.select("fips", "state_abbr", F.row_number().over(Window.partitionBy("state_abbr").orderBy("fips")).alias("place"))


@query
def iso_week_users(s, d):
    return keyed_messages(s, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_posts"))


@query
def mixed_week_users(s, d):
    m = distinct_messages(s, d)
    return messages.key_messages(m, "user_id", ["created_at", "date2", "date3"], mode="mixed").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_posts"))


@query
def unpadded_week_users(s, d):
    m = distinct_messages(s, d)
    key = K.dated_group(F.col("user_id"), F.col("created_at"), r"^(\d{4}-\d{2}-\d{2})")
    return m.where("user_id is not null").select(key.alias("group_id")).where("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_posts"))


@query
def posts_by_date(s, d):
    m = distinct_messages(s, d)
    return m.select(K.date_group(F.col("created_at"), r"^(\d{4}-\d{2}-\d{2})").alias("day")).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n_posts"))


@query
def posting_threshold(s, d):
    return messages.with_min_posts(keyed_messages(s, d), "group_id", 3).select("group_id", "message_id")


# --- n-grams and feature tables --------------------------------------------
@query
def ngrams_1(s, d):
    return ngrams.extract_ngrams(keyed_messages(s, d), "group_id", "message").select("group_id", "feat", "value", r6("group_norm"))


@query
def ngrams_1_to_3_by_source(s, d):
    out = ngrams.extract_ngrams(table(s, d, "documents"), "source", "text", (1, 2, 3), tokenize=X.whitespace_tokens)
    return out.select("group_id", "n", "feat", "value", r6("group_norm"))


@query
def ngrams_min_value(s, d):
    out = ngrams.extract_ngrams(keyed_messages(s, d), "user_id", "message", (2,), tokenize=X.whitespace_tokens, min_value=3)
    return out.select("group_id", "feat", "value", r6("group_norm"))


@query
def ngrams_binary(s, d):
    return ngrams.extract_ngrams(keyed_messages(s, d), "user_id", "message", tokenize=X.whitespace_tokens, binary=True).select("group_id", "feat", "value", "group_norm")


@query
def ngrams_whitelist(s, d):
    """Bigrams over the lexicon's words; others are out of vocabulary."""
    words = lexicon.vocabulary(table(s, d, "lexicon")).agg(F.collect_list("term").alias("w"))  # the lexicon is of fixed size
    m = keyed_messages(s, d).withColumn("w", words.scalar())
    out = ngrams.extract_ngrams(m, "user_id", "message", (2,), tokenize=lambda c: X.whitespace_tokens(F.lower(c)), whitelist="w")
    return out.select("group_id", "feat", "value", r6("group_norm"))


@query
def group_norms(s, d):
    return ngrams.with_group_norm(stored_features(s, d).drop("group_norm")).select("group_id", "feat", "value", r6("group_norm"))


@query
def repeated_features_compat(s, d):
    f = clean_features(s, d).where("group_id is not null and term is not null")
    rows = f.where("feat_count > 0 and not isnan(feat_count) and feat_freq > 0 and feat_freq <= 1").select("group_id", F.col("term").alias("feat"), F.col("feat_count").alias("value"), F.col("feat_freq").alias("group_norm"))
    return FT.merge_repeated(rows, "compat")


@query
def rare_features_folded(s, d):
    return FT.fold_rare(stored_features(s, d), 0.01).select("group_id", "feat", r6("value"), r6("group_norm"))


@query
def document_frequencies(s, d):
    return FT.document_frequency(feature_table(s, d))


@query
def anscombe(s, d):
    return FT.anscombe_rebase(stored_features(s, d), ("2020_01", "2021_01")).select("group_id", "feat", r6("value"), r6("group_norm"))


@query
def vocabulary_filter(s, d):
    return FT.filter_vocabulary(feature_table(s, d), table(s, d, "lexicon")).select("group_id", "feat", r6("value"))


# --- lexicon scores ---------------------------------------------------------
@query
def lexicon_last_weights(s, d):
    return lexicon_weights(s, d)


@query
def lexicon_scores(s, d):
    return scores(s, d).select("group_id", "category", r6("value"), r6("score"))


@query
def lexicon_scores_matched(s, d):
    out = lexicon.score(feature_table(s, d), lexicon_weights(s, d), False, weighted_counts=True)
    return out.select("group_id", "category", r6("value"), r6("score"), r6("weighted_value"))


@query
def category_counts(s, d):
    return lexicon.category_counts(feature_table(s, d), lexicon_weights(s, d)).select("group_id", "category", r6("value"))


@query
def clamped_scores(s, d):
    return FT.clamp_scores(score_features(s, d), categories=["DEP_SCORE", "ANX_SCORE", "ANG_SCORE"]).select("group_id", "feat", r6("group_norm"))


@query
def standardized_scores(s, d):
    return FT.clamp_scores(stored_scores(s, d), standardize=True).select("group_id", "feat", r6("group_norm"))


@query
def recentered_scores(s, d):
    return FT.clamp_scores(stored_scores(s, d), standardize=True, recenter=True, clamp_again=True).select("group_id", "feat", r6("group_norm"))


@query
def week_bounds(s, d):
    return FT.week_bounds(score_features(s, d)).select("yw", "feat", *[r6(c) for c in ("mean", "sd", "low", "high")])


@query
def sigma_reset(s, d):
    return FT.reset_outliers(stored_scores(s, d)).select("group_id", "feat", r6("group_norm"))


@query
def min_max_scores(s, d):
    return FT.scale_min_max(stored_scores(s, d)).select("group_id", "feat", "group_norm")


# --- places and weights -----------------------------------------------------
@query
def with_county(s, d):
    return geo.add_county(feature_table(s, d), geo.user_counties(table(s, d, "user_county"))).select("group_id", "feat", r6("value"), "cnty")


@query
def without_county(s, d):
    return geo.without_county(feature_table(s, d), geo.user_counties(table(s, d, "user_county"))).select("group_id", "feat", r6("value"))


@query
def with_weight(s, d):
    return geo.add_weight(feature_table(s, d), geo.group_weights(table(s, d, "group_weight"))).select("group_id", "feat", r6("value"), r6("weight"))


@query
def reweighted(s, d):
    return geo.reweight(feature_table(s, d), geo.group_weights(table(s, d, "group_weight"))).select("group_id", "feat", r6("value"), r6("group_norm"))


@query
def reweighted_matched(s, d):
    return geo.reweight(feature_table(s, d), geo.group_weights(table(s, d, "group_weight")), "drop").select("group_id", "feat", r6("value"), r6("group_norm"))


@query
def not_reweighted(s, d):
    return geo.reweight(feature_table(s, d), geo.group_weights(table(s, d, "group_weight")), "only").select("group_id", "feat", r6("value"), r6("group_norm"))


@query
def super_counties(s, d):
    """Divisions as super-counties: counties of odd number stand alone, every fourth is dropped, the others go to their division with weight 0.5."""
    fips = F.col("fips")
    mapping = table(s, d, "county_dim").select(
        F.lpad(fips.cast("string"), 5, "0").alias("cnty"), F.concat(F.lit("d"), F.col("division")).alias("super_cnty"), F.when(fips % 4 == 3, 0.0).when(fips % 2 == 1, 1.0).otherwise(0.5).alias("super_weight")
    )
    rows = materialize(geo.add_weight(geo.add_county(score_features(s, d), geo.user_counties(table(s, d, "user_county"))), geo.group_weights(table(s, d, "group_weight"))), "located")
    out = geo.aggregate_places(geo.spread_super_counties(rows, mapping))
    return out.select("key", "feat", r6("sum_N_lexwords"), r6("wavg_score"), r6("avg_score"), "N_users")


def _place_columns(df: DataFrame) -> DataFrame:
    return df.select("key", "feat", *[r6(c) for c in ("sum_N_lexwords", "wavg_score", "avg_score")], F.round("std_score", 4).alias("std_score"), F.round("wstd_score", 4).alias("wstd_score"), "N_users", "Space", "Time")


@query
def county_weeks(s, d):
    return _place_columns(places(s, d))


@query
def county_months(s, d):
    return _place_columns(places(s, d, "month"))


@query
def county_years(s, d):
    return _place_columns(places(s, d, "year"))


@query
def county_weeks_min_users(s, d):
    return geo.with_min_users(places(s, d), 3).select("key", "feat", r6("wavg_score"), "N_users")


# --- post-stratification ----------------------------------------------------
def incomes(s: SparkSession, d: str) -> DataFrame:
    """One predicted income per user and week: the exponential of a score-like log income made from the user's number and mean weight."""
    w = table(s, d, "group_weight").groupBy("user_id", "year_week").agg(F.max("cnty").alias("cnty"), F.max("weight").alias("weight"))
    log_income = 8.6 + F.ln(F.col("weight")) + (F.substring_index("user_id", ":", -1).cast("long") % 97) / 24.0
    return w.where("cnty is not null and weight > 0").select("user_id", F.col("year_week").alias("yw"), "cnty", N.income_from_log(log_income).alias("income"))


def census(s: SparkSession, d: str) -> DataFrame:
    """Ten income percentages for every county."""
    fips = F.col("fips")
    raw = [1 + (fips * (i + 3)) % 11 for i in range(10)]
    total = sum(raw[1:], raw[0])
    return table(s, d, "county_dim").select(F.lpad(fips.cast("string"), 5, "0").alias("cnty"), *[(100.0 * r / total).alias(f"pct_{i + 1}") for i, r in enumerate(raw)])


@query
def income_bins(s, d):
    return incomes(s, d).select("user_id", N.income_bin(F.col("income")).alias("bin"), r6(F.round("income", 2), "income"))


@query
def income_bin_shares(s, d):
    return weights.bin_shares(incomes(s, d), "income", weights.INCOME.edges).select("cnty", "yw", "bin", "n", r6("share"))


@query
def income_redistributed(s, d):
    out = weights.redistribute_incomes(incomes(s, d), repair_top=True)
    return out.select("user_id", F.round("income_redist", 3).alias("income_redist"), N.income_bin(F.round("income_redist", 3)).alias("bin"))


@query
def poststratified(s, d):
    return weights.poststratify(incomes(s, d), census(s, d)).select("user_id", "cnty", "yw", r6("weight"))


@query
def poststratified_uninformed(s, d):
    return weights.poststratify(incomes(s, d), census(s, d), uninformed=True).select("user_id", "cnty", "yw", r6("weight"))


@query
def poststratified_min_bin(s, d):
    return weights.poststratify(incomes(s, d), census(s, d), min_bin=2).select("user_id", "cnty", "yw", r6("weight"))


@query
def poststratified_smooth_first(s, d):
    return weights.poststratify(incomes(s, d), census(s, d), min_bin=2, smooth_first=True).select("user_id", "cnty", "yw", r6("weight"))


@query
def counties_filled(s, d):
    """Counties of weights replaced by those of users, where known."""
    w = table(s, d, "group_weight").select(F.substring_index("user_id", ":", -1).alias("entity"), "year_week", "cnty").distinct()
    return weights.fill_from(w, geo.user_counties(table(s, d, "user_county")), "entity", ["cnty"])


def demographics(s: SparkSession, d: str) -> DataFrame:
    """An age, gender and education for every user and week, made from the user's number."""
    n = F.substring_index("user_id", ":", -1).cast("long")
    w = table(s, d, "group_weight").groupBy("user_id", "year_week").agg(F.max("cnty").alias("cnty"))
    return w.where("cnty is not null").select("user_id", F.col("year_week").alias("yw"), "cnty", (13 + n * 7 % 68).cast("double").alias("age"), (n % 2 * 1.0).alias("gender"), (n % 3 / 2.0).alias("education"))


def _census_of(s: SparkSession, d: str, dem: weights.Demographic) -> DataFrame:
    """Percentages of the demographic's bins for every county, made from the county's number."""
    fips = F.col("fips")
    raw = [1 + (fips * (i + 3)) % 11 for i in range(len(dem.census))]
    total = sum(raw[1:], raw[0])
    return table(s, d, "county_dim").select(F.lpad(fips.cast("string"), 5, "0").alias("cnty"), *[(100.0 * r / total).alias(c) for c, r in zip(dem.census, raw)])


def _poststratified_by(s: SparkSession, d: str, dem: weights.Demographic) -> DataFrame:
    return weights.poststratify(demographics(s, d), _census_of(s, d, dem), dem).select("user_id", "cnty", "yw", r6("weight"))


@query
def poststratified_age(s, d):
    return _poststratified_by(s, d, weights.AGE)


@query
def poststratified_gender(s, d):
    return _poststratified_by(s, d, weights.GENDER)


@query
def poststratified_education(s, d):
    return _poststratified_by(s, d, weights.EDUCATION)


@query
def incomes_filled(s, d):
    """Six income columns of users replaced by those of another table, where it has them."""
    names = [f"inc_{i}" for i in range(6)]
    ids = table(s, d, "user_county").where("user_id is not null").select("user_id").distinct()
    target = ids.select(F.col("user_id").cast("string").alias("entity"), *[(F.col("user_id") % (i + 5)).cast("double").alias(c) for i, c in enumerate(names)])
    source = ids.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("entity"), *[F.when(F.col("user_id") % (i + 2) != 0, (F.col("user_id") * (i + 1)).cast("double")).alias(c) for i, c in enumerate(names)])
    return weights.fill_from(target, source, "entity", names)


# --- trends and panels ------------------------------------------------------
@query
def weekly_series(s, d):
    out = trends.weekly_series(materialize(places(s, d), "places"))
    return out.select("yearweek", "date", "n", *[r6(c) for c in out.columns if c not in ("yearweek", "date", "n")])


@query
def grain_means(s, d):
    panel = place_panel(s, d).withColumns({"month": F.date_format(K.week_days(F.col("yw"))["thursday"], "yyyy_MM"), "quarter": K.date_quarter(K.week_days(F.col("yw"))["thursday"])})
    out = trends.grain_means(panel, "dep", [["yw"], ["cnty"], ["month"], ["quarter"], ["region_name"], ["region_name", "quarter"], ["state_abbr"], []])
    return out.select("yw", "cnty", "month", "quarter", "region_name", "state_abbr", "grain", "n", r6("mean"))


@query
def means_and_errors(s, d):
    return trends.mean_and_error(place_panel(s, d), ["division", "yw"], "anx").select("division", "yw", "n", r6("mean"), r6("sem"))


@query
def year_over_year(s, d):
    return trends.year_over_year(stored_panel(s, d), "cnty", "yw", "dep").select("cnty", "week_no", r6("later"), r6("earlier"), r6("diff"))


@query
def centered_scores(s, d):
    out = trends.center_within(stored_panel(s, d), "cnty", ["dep", "anx"])
    return out.select("cnty", "yw", *[r6(c) for c in ("dep_mean", "dep_centered", "anx_mean", "anx_centered")])


@query
def full_coverage(s, d):
    """Divisions with a row in every quarter."""
    panel = materialize(place_panel(s, d).withColumn("quarter", K.date_quarter(K.week_monday(F.col("yw")))).groupBy("division", "quarter").agg(F.avg("dep").alias("dep")), "panel")
    return trends.full_coverage(panel, "division", "quarter").select("division", "quarter", r6("dep"))


@query
def busiest_county(s, d):
    """The county or counties with most users in each state."""
    users = geo.user_counties(table(s, d, "user_county")).groupBy("cnty").agg(F.count(F.lit(1)).alias("n_users"))
    dim = table(s, d, "county_dim").select(F.lpad(F.col("fips").cast("string"), 5, "0").alias("cnty"), "state_abbr")
    return trends.largest_per(users.join(dim, "cnty"), "state_abbr", "n_users").select("state_abbr", "cnty", "n_users")


@query
def score_correlations(s, d):
    return trends.correlations(place_panel(s, d), ["dep", "anx", "ang", "n_users"]).select("a", "b", "n", r6("r"))


@query
def score_correlations_by_region(s, d):
    return trends.correlations(place_panel(s, d), ["dep", "anx"], ["region_name"]).select("region_name", "a", "b", "n", r6("r"))


@query
def melted_panel(s, d):
    panel = place_panel(s, d).select("cnty", "yw", r6("dep"), r6("anx"), r6("ang"))
    return trends.melt(panel, ["cnty", "yw"], ["dep", "anx", "ang"])


@query
def counties_with_entries(s, d):
    return trends.with_min_entries(stored_panel(s, d), "cnty", 10).select("cnty", "yw", "n_users")


@query
def one_region(s, d):
    return trends.in_places(places(s, d).withColumnRenamed("Space", "cnty"), table(s, d, "county_dim").withColumn("cnty", F.lpad(F.col("fips").cast("string"), 5, "0")), "cnty", F.col("region") == 1).select("key", "feat", r6("wavg_score"))


@query
def weeks_before(s, d):
    series = trends.weekly_series(materialize(places(s, d), "places")).withColumn("compact", F.translate("yearweek", "_", ""))
    return trends.before(series, "date", "2020-07-01").select("yearweek", "date", K.split_week(F.col("compact")).alias("again"), K.label(F.col("yearweek"), F.date_format("date", "yyyy-MM-dd")).alias("label"), "n")


#: Spans that are marked in the weekly series.
EVENTS = {"autumn wave": ("2020-10-26", "2020-12-27"), "spring wave": ("2020-03-16", "2020-05-10"), "vote": ("2020-11-03", "2020-11-03")}


@query
def series_with_events(s, d):
    series = trends.weekly_series(materialize(places(s, d), "places"))
    return trends.mark_events(series, "date", EVENTS).select("yearweek", "date", "events", "n")


@query
def some_divisions(s, d):
    """Places of two divisions of states."""
    dim = table(s, d, "county_dim").withColumn("cnty", F.lpad(F.col("fips").cast("string"), 5, "0"))
    return trends.in_places(places(s, d).withColumnRenamed("Space", "cnty"), dim, "cnty", F.col("division").isin(1, 3)).select("key", "feat", r6("wavg_score"))


@query
def panel_summary(s, d):
    out = FT.summarize(stored_panel(s, d), ["dep", "anx", "ang"])
    return out.select("name", "n", *[r6(c) for c in ("mean", "sd", "least", "q25", "q50", "q75", "greatest")])


@query
def distinct_places(s, d):
    return place_panel(s, d).agg(F.count_distinct("cnty").alias("n_counties"), F.count_distinct("yw").alias("n_weeks"))


@query
def rolling_scores(s, d):
    return trends.rolling_mean(stored_panel(s, d), "yw", "dep", 4, ["cnty"]).select("cnty", "yw", r6("dep_rolling"))


# --- statistics -------------------------------------------------------------
def _effects(df: DataFrame, group: str) -> DataFrame:
    return df.select(group, "threshold", "n", r6("effect"), r6("effect_se"), "reliable")


def _monthly(s: SparkSession, d: str, feat: str) -> DataFrame:
    return placed_scores(s, d).where(F.col("feat") == feat).withColumn("key", geo.grain_key("month"))


@query
def reliability_d(s, d):
    return _effects(stats.reliability_hashed(_monthly(s, d, "DEP_SCORE"), "key", "group_norm", "group_id"), "key")


@query
def reliability_h(s, d):
    share = _monthly(s, d, "DEP_SCORE").withColumn("high", (F.col("group_norm") > 2.5).cast("double"))
    return _effects(stats.reliability_hashed(share, "key", "high", "group_id", "h"), "key")


@query
def reliability_single_split(s, d):
    return _effects(stats.reliability_hashed(placed_scores(s, d).where("feat = 'ANX_SCORE'"), "cnty", "group_norm", "group_id", n_perms=1), "cnty")


@query
def reliability_sweep(s, d):
    """Mean effect and share of reliable counties at each least number of values."""
    each = stats.reliability_hashed(placed_scores(s, d).where("feat = 'DEP_SCORE'"), "cnty", "group_norm", "group_id", thresholds=(3, 10, 30, 100))
    return each.where("effect is not null").groupBy("threshold").agg(F.count(F.lit(1)).alias("n_groups"), r6(F.avg("effect"), "effect"), r6(F.avg(F.col("reliable").cast("double")), "share_reliable"))


@query
def intraclass(s, d):
    out = stats.icc(placed_scores(s, d).where("feat = 'DEP_SCORE'"), "group_norm", "cnty", (0, 3, 10))
    return out.select("threshold", "n_groups", "n_obs", *[r6(c) for c in ("avg_n", "ms_between", "ms_within", "f", "icc1_ref", "icc1", "icc2_mean", "icc2_std")])


@query
def intraclass_p(s, d):
    return stats.icc(placed_scores(s, d).where("feat = 'ANX_SCORE'"), "group_norm", "cnty", (0, 3)).select("threshold", "f", "p_value")


@query
def regression(s, d):
    out = stats.simple_ols(place_panel(s, d), "dep", "anx", p_values=False)
    return out.select("n", *[r6(c) for c in ("slope", "intercept", "r2", "slope_se", "intercept_se")], F.round("slope_t", 4).alias("slope_t"))


def _coefficients(out: DataFrame, *keys: str) -> DataFrame:
    return out.select(*keys, "n", *[r6(c) for c in ("slope", "intercept", "r2", "slope_se", "intercept_se")], F.round("slope_t", 4).alias("slope_t"))


@query
def regression_by_region(s, d):
    return _coefficients(stats.simple_ols(place_panel(s, d), "dep", "anx", ["region_name"], p_values=False), "region_name")


@query
def regression_p(s, d):
    return stats.simple_ols(place_panel(s, d), "dep", "anx", ["region_name"]).select("region_name", "slope_t", "slope_p")


#: Pairs of panel columns that are regressed on each other, each way.
FORMULAS = (("dep", "anx"), ("dep", "ang"), ("anx", "ang"), ("dep", "n_users"))


@query
def regressions(s, d):
    """All formulas in one pass: y on x of every pair, and x on y."""
    both = [p for a, b in FORMULAS for p in ((a, b), (b, a))]
    each = F.array(*[F.struct(F.lit(f"{y} ~ {x}").alias("formula"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")) for y, x in both])
    return _coefficients(stats.simple_ols(place_panel(s, d).select(F.inline(each)), "y", "x", ["formula"], p_values=False), "formula")


@query
def mixed_model(s, d):
    return stats.random_intercept(place_panel(s, d), "dep", "anx", "division")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """From messages to lexicon scores of user-weeks: keys, threshold, 1-grams, shares, scores with intercepts."""
    cleaned = materialize(messages.clean_messages(keyed_messages(s, d), "message", "group_id", ["message_id", "created_at"]), "cleaned")
    grams = ngrams.extract_ngrams(messages.with_min_posts(cleaned, "group_id", 1), "group_id", "message", norm=False)
    scored = lexicon.score(ngrams.with_group_norm(materialize(grams, "ngrams")), lexicon_weights(s, d))
    # weights with few places make sums that lie exactly between two sixth places; the addend lets every engine round them up
    return scored.select("group_id", "category", r6("value"), r6(F.col("score") + 1e-9, "score"))


@query
def messages_to_scores(s, d):
    return flagship(s, d)


@query
def written_and_read(s, d):
    """Scores written once to the shared folder and read back by two uses."""
    kept = materialize(scores(s, d), "scores")
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total")).unionByName(kept.where("value > 0").groupBy(F.concat("category", F.lit("_matched")).alias("category")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total")))


@query
def pipeline_places(s, d):
    """All stages: messages to scored county-weeks."""
    out = pipeline.run(distinct_messages(s, d), table(s, d, "lexicon"), table(s, d, "user_county"), table(s, d, "group_weight"), pipeline.Settings(least_posts=1))
    return out.select("key", "feat", r6("sum_N_lexwords"), r6("wavg_score"), "N_users")


@query
def stream_ngrams(s, d):
    """Weekly 1-grams of the message table read as a stream, written and read back; the last weeks, which its watermark leaves open, are counted in a batch."""
    source = table(s, d, "messages")
    dates = ["created_at", "date2", "date3"]
    stream = counts.with_event_time(s.readStream.schema(source.schema).parquet(f"{d}/messages.parquet*"), dates)
    path = result_path(s, "stream")
    counts.write_ngrams(counts.weekly_ngrams(stream, "user_id", "message", late="10 days"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    written = s.read.schema("group_id string, feat string, value long").parquet(f"{path}/table")
    rest = counts.open_weeks(counts.with_event_time(source, dates), written)
    return written.unionByName(counts.weekly_ngrams(rest, "user_id", "message", late="10 days"))
