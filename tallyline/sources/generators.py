"""Seeded and continuing data: integer lists and timed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.payload_arrow import int_list_bytes, message_bytes
from tallyline.functions.scalars import (
    epoch_seconds,
    epoch_seconds_from_millis,
    message_content,
    to_timestamp,
)

# Fixed values of the generated data.
LIST_LENGTHS = (2, 5)
LIST_ITEMS = (0, 99)
MESSAGE_EVERY_SECONDS = 2


def _uniform(low: int, high: int, *seeds: Column) -> Column:
    """A whole number in low..high that depends on the seeds alone, so that a
    task that runs again writes the same rows."""
    return F.pmod(F.xxhash64(*seeds), F.lit(high - low + 1)) + F.lit(low)


def random_list(row_id: Column, seed: int) -> Column:
    length = _uniform(*LIST_LENGTHS, row_id, F.lit(seed), F.lit(0))
    items = [
        _uniform(*LIST_ITEMS, row_id, F.lit(seed), F.lit(position))
        for position in range(1, LIST_LENGTHS[1] + 1)
    ]
    return F.slice(F.array(*items), F.lit(1), length.cast("int"))


def with_random_list(df: DataFrame, id_column: str, seed: int = 0) -> DataFrame:
    """A list per row, as ``numbers`` and encoded as ``value``."""
    df = df.withColumn("numbers", random_list(F.col(id_column), seed))
    return df.withColumn("value", int_list_bytes("numbers"))


def gen_int_lists(
    spark: SparkSession, n: int, seed: int = 0, tasks: int | None = None
) -> DataFrame:
    """``n`` topic values holding lists; no key. The row number is kept as id."""
    rows = spark.range(0, n, 1, tasks)
    return with_random_list(rows, "id", seed).select("id", "value")


def gen_int_lists_stream(spark: SparkSession, rows_per_second: int, seed: int = 0) -> DataFrame:
    """The same rows without end, written by as many tasks as Spark has cores."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    rows = rows.withColumnRenamed("value", "id")
    return with_random_list(rows, "id", seed).select("id", "timestamp", "value")


def with_message(df: DataFrame, message_id: Column, event_time: Column) -> DataFrame:
    """The message of a row: id, time and content, and encoded as ``value``."""
    fields = {
        "message_id": message_id.cast("bigint"),
        "event_time": event_time.cast("double"),
        "content": message_content(message_id),
    }
    return df.withColumns({**fields, "value": message_bytes(*fields.values())})


def gen_messages(
    spark: SparkSession, n: int, t0: float, step: float = MESSAGE_EVERY_SECONDS
) -> DataFrame:
    """``n`` messages from time ``t0`` on, one every ``step`` seconds."""
    rows = spark.range(n)
    at = F.lit(float(t0)) + F.col("id") * F.lit(float(step))
    return (
        with_message(rows, F.col("id"), at)
        .withColumn("timestamp", to_timestamp(F.col("event_time")))
        .drop("id")
    )


def gen_messages_stream(
    spark: SparkSession,
    every_seconds: float = MESSAGE_EVERY_SECONDS,
    start_millis: int | None = None,
    per_batch: int = 1,
) -> DataFrame:
    """Messages without end. With ``start_millis`` the clock is simulated: each
    micro-batch adds ``per_batch`` rows and moves the time by one step."""
    if start_millis is None:
        # Ticks at least as often as messages; the first tick of each step is one.
        step = max(1, round(every_seconds * 1000))
        ticks = max(1, -(-1000 // step))
        rows = spark.readStream.format("rate").option("rowsPerSecond", ticks).load()

        def number(tick):
            return F.call_function("div", tick * 1000, F.lit(step * ticks))

        now, before = number(F.col("value")), number(F.col("value") - 1)
        rows = rows.where((F.col("value") == 0) | (now != before)).withColumn("value", now)
        event_time = epoch_seconds(F.col("timestamp"))
    else:
        rows = (
            spark.readStream.format("rate-micro-batch")
            .option("rowsPerBatch", per_batch)
            .option("advanceMillisPerBatch", int(every_seconds * 1000))
            .option("startTimestamp", start_millis)
            .load()
        )
        event_time = epoch_seconds_from_millis(F.unix_millis(F.col("timestamp")))
    rows = rows.withColumnRenamed("value", "id")
    return with_message(rows, F.col("id"), event_time).drop("id")
