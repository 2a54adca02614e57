"""Weekly n-gram counts of a message stream; an addition, as the domain's pipeline is batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions import text as X


def with_event_time(messages: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Adds ts, the first date that parses; rows without one are dropped."""
    return messages.withColumn("ts", K.first_timestamp([F.col(d) for d in dates])).where(F.col("ts").isNotNull())


def weekly_ngrams(messages: DataFrame, user: str, message: str, n: int = 1, late: str = "1 day", tokenize: Callable[[Column], Column] = X.tokens) -> DataFrame:
    """group_id, feat, value per ISO week (windows start on Mondays) of a stream or table with ts.

    State is kept per (week, user, n-gram) until the watermark passes the week's end by ``late``; later messages are dropped.
    """
    rows = messages.withWatermark("ts", late).where(F.col(user).isNotNull() & F.col(message).isNotNull())
    each = rows.select("ts", F.col(user).alias("_u"), F.explode(X.ngrams(tokenize(F.col(message)), n)).alias("feat"))
    # windows count from a Thursday (1970-01-01); four days later is a Monday
    counted = each.groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "_u", F.lower("feat").alias("feat")).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(F.concat_ws(":", K.iso_week(F.col("w.start")), "_u").alias("group_id"), "feat", "value")


def open_weeks(messages: DataFrame, written: DataFrame) -> DataFrame:
    """Messages (a table with ts) of the weeks that write_ngrams() hasn't written, as the watermark never passed their ends.

    A bounded run counts them in a batch once its stream is over; a stream that goes on writes them itself.
    """
    week = K.iso_week(F.window("ts", "7 days", startTime="4 days")["start"])
    done = written.select(F.substring_index("group_id", ":", 1).alias("_w")).distinct()
    return messages.withColumn("_w", week).join(F.broadcast(done), "_w", "left_anti").drop("_w")


def deduplicated(messages: DataFrame, key: Sequence[str], late: str = "1 day") -> DataFrame:
    """Repeated messages of a stream dropped while their watermark lasts."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def write_ngrams(counts: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append finished weeks to a Parquet table, exactly once through the checkpoint; ``once`` handles what is there and stops."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
