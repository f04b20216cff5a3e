"""The given tables as topics.

Each row of a table becomes one record, so topics grow with the tables and no
record depends on how many rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.payload_arrow import int_list_bytes, message_bytes
from tallyline.functions.scalars import epoch_seconds, message_content
from tallyline.operators.layout import with_offsets

PARTITIONS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its times without zone are taken as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a stream of its files."""
    batch = table(spark, sf_dir, name)
    # As a pattern, since the stream source takes no path of a single file.
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{name}.parque[t]")


def instant(ts: str) -> Column:
    return F.col(ts).cast("timestamp")


def text_key(column: str) -> Column:
    return F.encode(F.col(column).cast("string"), "UTF-8")


def from_text_key() -> Column:
    return F.col("key").cast("string").cast("bigint")


def partition_of(column: str) -> Column:
    return F.pmod(F.col(column), F.lit(PARTITIONS)).cast("int")


def _record(df: DataFrame, topic: str, *extra: str, **columns: Column) -> DataFrame:
    columns = {"topic": F.lit(topic), "timestampType": F.lit(0), **columns}
    names = ("key", "value", "topic", "partition", "offset", "timestamp", "timestampType")
    return df.select(*[columns[n].alias(n) for n in names], *extra)


def lineitem_lists(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """A list per line: its five whole numbers. Offsets grow with the file order, with gaps between the scan's tasks."""
    lines = table(spark, sf_dir, "lineitem")
    five = F.array(
        F.col("l_linenumber").cast("bigint"),
        F.col("l_quantity").cast("bigint"),
        F.col("l_suppkey"),
        F.col("l_partkey"),
        F.col("l_orderkey"),
    )
    lines = lines.withColumn("numbers", five)
    return _record(
        lines,
        "lists",
        "l_orderkey",
        "l_linenumber",
        "numbers",
        *extra,
        key=text_key("l_orderkey"),
        value=int_list_bytes("numbers"),
        partition=partition_of("l_orderkey"),
        offset=F.monotonically_increasing_id(),
        timestamp=instant("l_shipdate"),
    )


def document_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per document: the length of each of its words."""
    words = F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("bigint"))
    return _record(
        table(spark, sf_dir, "documents"),
        "documents",
        "doc_id",
        key=text_key("doc_id"),
        value=int_list_bytes(words),
        partition=partition_of("doc_id"),
        offset=F.col("doc_id"),
        timestamp=F.timestamp_seconds(F.col("doc_id")),
    )


def event_messages(
    spark: SparkSession, sf_dir: str, event_time: Column | None = None, *extra: str
) -> DataFrame:
    """A message per event, with the event id as offset. The value of an event
    is called ``delay`` here, since ``value`` is the payload."""
    events = table(spark, sf_dir, "events").withColumnRenamed("value", "delay")
    at = epoch_seconds(instant("ts")) if event_time is None else event_time
    return _record(
        events,
        "events",
        "event_id",
        "event_type",
        *extra,
        key=text_key("user_id"),
        value=message_bytes(F.col("event_id"), at, message_content(F.col("event_id"))),
        partition=partition_of("user_id"),
        offset=F.col("event_id"),
        timestamp=instant("ts"),
    )


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event topic with offsets 0, 1, 2, ... in each partition."""
    events = event_messages(spark, sf_dir).withColumnRenamed("offset", "_id")
    return with_offsets(events, order="_id").drop("_id")


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per order, sent at its date."""
    orders = table(spark, sf_dir, "orders")
    return _record(
        orders,
        "orders",
        key=text_key("o_custkey"),
        value=message_bytes(
            F.col("o_orderkey"),
            epoch_seconds(instant("o_orderdate")),
            message_content(F.col("o_orderkey")),
        ),
        partition=partition_of("o_custkey"),
        offset=F.col("o_orderkey"),
        timestamp=instant("o_orderdate"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per document, its whole text as content."""
    return _record(
        table(spark, sf_dir, "documents"),
        "documents",
        key=text_key("source"),
        value=message_bytes(F.col("doc_id"), F.col("n_chars").cast("double"), F.col("text")),
        partition=partition_of("doc_id"),
        offset=F.col("doc_id"),
        timestamp=F.timestamp_seconds(F.col("doc_id")),
    )
