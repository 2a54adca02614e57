"""Queries that write tables to the shared folder and read them back through the library's readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyloom.operators import lexicon
from tallyloom.plans.tables import table
from tallyloom.sources import tables as S
from tallyloom.storage import result_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "messages").select("message_id", "user_id", "message", "created_at", "date2", "date3").distinct()


def _one_line(s: SparkSession, d: str) -> DataFrame:
    """Messages without line breaks and backslashes, which a line format can hold."""
    return _messages(s, d).where(F.col("message").isNotNull() & ~F.col("message").rlike(r"[\n\r\\]"))


@query
def messages_from_csv(s, d):
    """Quoted CSV with line breaks inside fields, written in slices and read by a list of paths; ``NULL`` is null."""
    path = result_path(s, "messages-csv")
    rows = _messages(s, d).withColumn("message", F.regexp_replace("message", "\\r\\n?", "\n"))
    S.write_csv(rows.where("message_id < 'm5'"), f"{path}/a")
    S.write_csv(rows.where("not (message_id < 'm5') or message_id is null"), f"{path}/b")
    return S.read_csv(s, [f"{path}/a,{path}/b"], S.MESSAGES, rejected=f"{path}/rejected").select("message_id", "user_id", "message", "created_at")


@query
def messages_from_lines(s, d):
    """Lines with a number and a tab before each record and quotes escaped by backslashes."""
    path = result_path(s, "messages-lines")
    m = _one_line(s, d)
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("NULL")), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in m.columns]
    line = F.concat(F.length("message"), F.lit("\t"), F.concat_ws(",", *quoted))
    m.select(line.alias("value")).unionByName(s.createDataFrame([("1\tonly,three,fields",)], "value string")).write.text(path)
    return S.read_repaired_lines(s, path, S.MESSAGES.names, f"{path}-rejected").select("message_id", "user_id", "message")


@query
def rejected_records(s, d):
    """Records that have too few fields are set aside, not lost."""
    path = result_path(s, "rejected")
    S.write_csv(table(s, d, "nation").select("n_name", "n_regionkey"), f"{path}/in")
    made = S.read_csv(s, f"{path}/in", S.LEXICON, rejected=f"{path}/out")
    kept = made.count()
    return s.read.text(f"{path}/out").agg(F.count(F.lit(1)).alias("n_rejected")).withColumn("n_kept", F.lit(kept).cast("long"))


@query
def messages_from_path_list(s, d):
    """The files named in a list file."""
    path = result_path(s, "listed")
    m = _one_line(s, d)
    for k in range(3):
        S.write_csv(m.where(F.pmod(F.hash("message_id"), F.lit(3)) == k), f"{path}/part{k}")
    s.createDataFrame([(f"{path}/part0",), (" ",), (f"{path}/part2",), (f"{path}/part1",)], "value string").coalesce(1).write.text(f"{path}/list")
    return S.read_csv(s, S.read_path_list(s, f"{path}/list"), S.MESSAGES).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query
def lexicon_from_csv(s, d):
    """A lexicon file in which the last of repeated rows wins."""
    path = result_path(s, "lexicon")
    # the table's rows in its own order, some repeated with another weight
    lex = table(s, d, "lexicon").withColumn("weight", F.col("weight") + 0.0).where("term is not null and category is not null and weight is not null").groupBy("term", "category").agg(F.max("weight").alias("weight"))
    first = lex.withColumn("weight", F.col("weight") + 5).orderBy("term", "category")
    S.write_csv(first.coalesce(1), f"{path}/lex.csv/a", header=True)
    S.write_csv(lex.orderBy("category", "term").coalesce(1), f"{path}/lex.csv/b", header=True)
    read = S.read_lexicon(s, f"{path}/lex.csv/[ab]/*.csv")
    return lexicon.last_weights(read, "position")


@query
def whitelist_words(s, d):
    """A whitelist file, one word a line."""
    path = result_path(s, "whitelist")
    lexicon.vocabulary(table(s, d, "lexicon")).where("trim(term) <> ''").select(F.trim("term").alias("value")).write.text(path)
    return S.read_whitelist(s, path).select(F.explode("words").alias("word"))


@query
def counties_from_csv(s, d):
    """Named columns of a dimension written as CSV with a header."""
    path = result_path(s, "dim") + ".csv"
    S.write_csv(table(s, d, "county_dim"), path, header=True, quote_all=False)
    return S.read_table(s, path.removesuffix(".csv"), ["fips", "state_name", "region_name"], kind="csv")


@query
def loaded_features(s, d):
    """A CSV export loaded into a partitioned table and read by columns."""
    path = result_path(s, "load")
    w = table(s, d, "group_weight").where("user_id is not null and weight is not null")
    S.write_csv(w.select("user_id", "year_week", "cnty", "weight"), f"{path}/csv")
    S.write_table(S.read_csv(s, f"{path}/csv", S.GROUP_WEIGHT), f"{path}/table", ["cnty"])
    return S.read_table(s, f"{path}/table", ["user_id", "weight"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def appended_weights(s, d):
    """A table of weights to which a second run adds its rows."""
    path = result_path(s, "weights")
    w = table(s, d, "group_weight").where("user_id is not null").select("user_id", "year_week", "weight")
    S.append_table(w.where("year_week < '2020_01'"), path)
    S.append_table(w.where("not (year_week < '2020_01')").select("weight", "year_week", "user_id"), path)
    return s.read.parquet(path).groupBy("year_week").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def existing_output_refused(s, d):
    """A second write to the same path is an error unless it is allowed."""
    path = result_path(s, "guard")
    r = table(s, d, "region").select("r_regionkey", "r_name")
    S.write_csv(r, path)
    try:
        S.write_csv(r, path)
        refused = False
    except AnalysisException:
        refused = True
    S.write_csv(r, path, exist_ok=True)
    return s.read.csv(path).select(F.col("_c1").alias("r_name"), F.lit(refused).alias("refused"))


@query
def made_once(s, d):
    """A table that is made at the first use and read at the second."""
    path = result_path(s, "once")
    made = []

    def make() -> DataFrame:
        made.append(1)
        return table(s, d, "county_dim").groupBy("region").agg(F.count(F.lit(1)).alias("n"))

    S.compute_once(s, path, make)
    return S.compute_once(s, path, make).withColumn("times_made", F.lit(len(made)))


@query
def through_database(s, d):
    """A table written to a database and read back by a query. The database is the embedded one that comes with Spark, in the driver's memory: a local session's tasks reach it, on a cluster the driver alone does."""
    s.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:{s.sparkContext.applicationId.replace('-', '')};create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    dim = table(s, d, "county_dim").select("fips", F.col("state_abbr").alias("state"), "region")
    S.write_jdbc(dim, url, "county_dim", driver=driver, createTableColumnTypes="state VARCHAR(8)")
    return S.read_jdbc(s, url, 'SELECT "state", "region", count(*) AS n FROM county_dim GROUP BY "state", "region"', driver=driver).toDF("state", "region", "n")
