"""The end-to-end jobs as plain DataFrame pipelines.

The same functions serve a bounded read and a stream: they only select, filter
and decode. ``streaming.jobs`` starts them as streaming queries.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.metrics import throughput
from tallyline.operators.payloads import (
    decode_messages,
    decode_sums,
    drop_null_values,
    resum_int_lists,
    with_defaults,
)
from tallyline.operators.transforms import format_report, receipt_time, with_latency
from tallyline.sources.generators import gen_int_lists
from tallyline.sources.spec import TopicSpec
from tallyline.sources.topics import read_topic_batch, write_topic

SUMS, QUARANTINE = "sums", "quarantine"


def stream_sum(
    df: DataFrame, out_topic: str = SUMS, bad_topic: str = QUARANTINE, engine: str = "arrow"
) -> DataFrame:
    """Reads lists, sums each one, and yields the rows to be written.

    A good row goes to ``out_topic`` with its key, place and time and the
    encoded sum; a row that cannot be read goes to ``bad_topic`` with its
    payload unchanged and the reason. Both kinds come from one pass.
    """
    summed = resum_int_lists(drop_null_values(df), engine=engine)
    topic = F.when(F.col("error").isNull(), F.lit(out_topic)).otherwise(F.lit(bad_topic))
    return summed.select(
        "key",
        "value",
        topic.alias("topic"),
        "partition",
        "offset",
        "timestamp",
        "error",
    )


def message_monitor(
    df: DataFrame,
    received: Column | None = None,
    style: str = "fixed",
    policy: str | None = None,
    engine: str = "arrow",
) -> DataFrame:
    """Decodes messages and reports each with its latency; ``policy`` says what
    stands in for missing fields. Rows that cannot be read keep place, payload
    and reason and have no report."""
    decoded = decode_messages(drop_null_values(df), engine=engine)
    if policy is not None:
        at = receipt_time(df) if received is None else received
        decoded = with_defaults(decoded.withColumn("received_time", at), policy)
    reported = format_report(with_latency(decoded, received), style)
    return reported.select(
        "topic",
        "partition",
        "offset",
        F.when(F.col("error").isNotNull(), F.col("value")).alias("value"),
        "message_id",
        "event_time",
        "content",
        "received_time",
        "latency",
        *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("line", "latency_line")],
        "error",
    )


def result_tail(df: DataFrame, seconds: int = 5) -> DataFrame:
    """Reads sums and counts results per window."""
    sums = decode_sums(drop_null_values(df)).where(F.col("error").isNull())
    return throughput(sums, seconds=seconds)


@dataclass(frozen=True)
class Backlog:
    """The timed run over a backlog: what was read and written, and how fast."""

    rows: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.rows / self.seconds


def load_backlog(
    spark: SparkSession, spec: TopicSpec, rows: int, seed: int = 0, tasks: int | None = None
) -> None:
    """Fills a topic with generated lists, spread over its partitions."""
    lists = gen_int_lists(spark, rows, seed, tasks)
    partition = F.pmod(F.spark_partition_id(), F.lit(spec.partitions)).cast("int")
    offset = F.col("id").alias("offset")
    write_topic(lists.select("value", partition.alias("partition"), offset), spec)


def process_backlog(spark: SparkSession, source: TopicSpec, sink: TopicSpec) -> float:
    """Reads the whole backlog, sums every list and writes the sums; returns
    the seconds it took."""
    begin = time.perf_counter()
    write_topic(stream_sum(read_topic_batch(spark, source), sink.topic), sink)
    return time.perf_counter() - begin


def run_backlog(
    spark: SparkSession, source: TopicSpec, sink: TopicSpec, rows: int, seed: int = 0
) -> Backlog:
    load_backlog(spark, source, rows, seed)
    return Backlog(rows, process_backlog(spark, source, sink))


def run_row(spark: SparkSession, run: Backlog, name: str) -> DataFrame:
    """A run as a row of a table of runs."""
    return spark.createDataFrame(
        [(name, run.rows, run.seconds, run.per_second)],
        "run string, total bigint, seconds double, per_sec double",
    )
