"""Start the jobs as Structured Streaming queries.

Each consumer group keeps its own progress (``session.checkpoint_path``): a
query that is started again goes on where its group stopped, and two groups
read the same topic independently. Table sinks commit a batch as a whole and
once; broker sinks deliver at least once.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyline.functions.scalars import percent_done
from tallyline.operators.layout import first_records
from tallyline.operators.metrics import consumer_lag, lag_lines, observe_stream
from tallyline.plans import jobs
from tallyline.session import checkpoint_path
from tallyline.sources.commits import follow, never_written, progress_ticks
from tallyline.sources.generators import gen_int_lists_stream, gen_messages_stream
from tallyline.sources.spec import TopicSpec
from tallyline.sources.topics import read_topic_stream, write_topic_stream

LAG_EVERY = "2 seconds"


def start_stream_sum(
    spark: SparkSession, source: TopicSpec, sink: TopicSpec, drain: bool = True
) -> StreamingQuery:
    """Lists in, sums and set-aside rows out; null payloads are dropped and
    counted in the progress of the query."""
    job = "stream_sum"
    seen = observe_stream(read_topic_stream(spark, source, job))
    routed = jobs.stream_sum(seen, sink.topic)
    return write_topic_stream(routed, sink, source.group, job, drain)


def start_message_monitor(
    spark: SparkSession,
    source: TopicSpec,
    out: str | None = None,
    received: Column | None = None,
    drain: bool = True,
) -> StreamingQuery:
    """Reports of a message topic, to a table split into ``ok`` and
    ``quarantine``, or to the console where no path is given."""
    job = "message_monitor"
    reports = jobs.message_monitor(read_topic_stream(spark, source, job), received)
    outcome = F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("quarantine"))
    writer = reports.withColumn("outcome", outcome).writeStream.outputMode("append")
    writer = (
        writer.format("console")
        if out is None
        else writer.format("parquet").option("path", out).partitionBy("outcome")
    )
    return _start(writer, spark, source.group, job, drain)


FOLD_EVERY = 32  # batches of the result tail between two folds


def start_result_tail(
    spark: SparkSession,
    source: TopicSpec,
    out: str,
    seconds: int = 5,
    watermark: str | None = None,
    drain: bool = True,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Results per window. Every batch stores the windows it changed, and every
    ``fold_every`` batches the last state of all windows is folded into one table; read
    both with ``latest_windows``. With a watermark Spark forgets windows that are
    older, and results that come later than that are not counted.

    Batches take turns in twice as many places as a fold takes in, and folds in two, so
    the folder does not grow with the number of batches. A batch that runs again
    replaces itself: what it folds, the fold before and the batches since then, is
    still there."""
    job = "result_tail"
    rows = read_topic_stream(spark, source, job)
    rows = rows if watermark is None else rows.withWatermark("timestamp", watermark)
    counted = jobs.result_tail(rows, seconds)

    def store(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("batch", F.lit(number).cast("bigint"))
        numbered.write.mode("overwrite").parquet(f"{out}/batch/slot={number % (2 * fold_every)}")
        if (number + 1) % fold_every == 0:
            turn = (number + 1) // fold_every % 2
            state = _tail_state(spark, out, number).withColumn("upto", F.lit(number).cast("bigint"))
            state.write.mode("overwrite").parquet(f"{out}/fold/slot={turn}")

    writer = counted.writeStream.outputMode("update").foreachBatch(store)
    return _start(writer, spark, source.group, job, drain)


_WINDOWS = "window_start timestamp, n bigint, per_sec bigint, rate double, batch bigint"


def _stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        never_written(problem)
        return spark.createDataFrame([], schema)


def _tail_state(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """``batch`` and the last state of each window, from the newest fold and the batches
    behind it; for the fold of batch ``upto``, from those before it."""
    folds = _stored(spark, f"{out}/fold", f"{_WINDOWS}, upto bigint")
    since = _stored(spark, f"{out}/batch", _WINDOWS)
    if upto is not None:
        folds = folds.where(F.col("upto") < upto)
        since = since.where(F.col("batch") <= upto)
    newest = folds.agg(F.max("upto")).first()[0]
    if newest is not None:
        since = since.where(F.col("batch") > newest)
    columns = ("window_start", "n", "per_sec", "rate", "batch")
    folded = folds.where(F.col("upto") == newest).select(*columns)
    last = F.max_by(F.struct(*columns[1:]), "batch").alias("_last")
    states = folded.union(since.select(*columns)).groupBy("window_start").agg(last)
    return states.select("window_start", "_last.*")


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each window that ``start_result_tail`` stored."""
    return _tail_state(spark, out).drop("batch")


def start_first_records(
    spark: SparkSession, source: TopicSpec, out: str, n: int, drain: bool = True
) -> StreamingQuery:
    """Exactly ``n`` records of a topic (all, if it has fewer), as a table; then the query
    ends. The batch that reaches ``n`` is cut, in the order of partition and offset; a
    second start adds nothing. Every batch is stored under its number, so one that runs
    again replaces itself and is cut alike."""
    job = "first_records"
    rows = read_topic_stream(spark, source, job)
    numbered = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])
    query: list[StreamingQuery] = []

    def store(batch: DataFrame, number: int) -> None:
        done = _stored(spark, out, numbered).where(F.col("batch") < number).count()
        if done < n:
            place = f"{out}/batch={number}"
            first_records(batch, n - done).write.mode("overwrite").parquet(place)
            done += spark.read.schema(rows.schema).parquet(place).count()
        if done >= n:
            # From another thread, as this one belongs to the query.
            threading.Thread(target=lambda: query and query[0].stop(), daemon=True).start()

    writer = rows.writeStream.outputMode("append").foreachBatch(store)
    query.append(_start(writer, spark, source.group, job, drain))
    return query[0]


def backlog_progress(spark: SparkSession, source: TopicSpec, total: int, job: str) -> DataFrame:
    """Progress of a running or ended job over a backlog of ``total`` records: one tick
    per batch, with the records done and the whole percent after it."""
    ticks = progress_ticks(spark, source, job)
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.sum("n").over(upto)
    pct = percent_done(done, F.lit(total).cast("bigint"))
    return ticks.select("batch", "tick", "n", done.alias("done"), pct.alias("pct"))


def start_message_feed(
    spark: SparkSession, sink: TopicSpec, start_millis: int | None = None, per_batch: int = 1
) -> StreamingQuery:
    """Messages without end, one every two seconds, into a topic."""
    feed = gen_messages_stream(spark, start_millis=start_millis, per_batch=per_batch)
    rows = feed.select(
        "value", "timestamp", F.col("message_id").alias("offset"), F.lit(0).alias("partition")
    )
    return write_topic_stream(rows, sink, sink.group, "message_feed", drain=False)


def start_list_feed(
    spark: SparkSession, sink: TopicSpec, rows_per_second: int, seed: int = 0
) -> StreamingQuery:
    """Random integer lists without end into a topic."""
    feed = gen_int_lists_stream(spark, rows_per_second, seed)
    partition = F.pmod(F.col("id"), F.lit(sink.partitions)).cast("int")
    rows = feed.withColumn("partition", partition).withColumnRenamed("id", "offset")
    return write_topic_stream(rows, sink, sink.group, "list_feed", drain=False)


def start_lag_monitor(
    spark: SparkSession,
    committed: Callable[[], DataFrame],
    ends: Callable[[], DataFrame],
    groups: DataFrame | None = None,
    report: Callable[[DataFrame], None] | None = None,
    every: str = LAG_EVERY,
    name: str = "lag_monitor",
) -> StreamingQuery:
    """Looks at both offset tables at a fixed pace and reports the lag. Without
    ``report`` the lines are printed, which is meant for a few named groups."""

    def look(_: DataFrame, __: int) -> None:
        lag = lag_lines(consumer_lag(committed(), ends(), groups))
        (report or _print_lines)(lag)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    place = f"{checkpoint_path(spark, name, 'lag_monitor')}/progress"
    writer = ticks.writeStream.foreachBatch(look).option("checkpointLocation", place)
    return writer.trigger(processingTime=every).start()


def _print_lines(lag: DataFrame) -> None:
    """One line per group; groups are few."""
    for row in lag.select("line").toLocalIterator():
        print(row["line"], flush=True)


def _start(writer, spark: SparkSession, group: str, job: str, drain: bool) -> StreamingQuery:
    place = f"{checkpoint_path(spark, group, job)}/progress"
    writer = writer.option("checkpointLocation", place).queryName(f"{group}.{job}")
    writer = writer.trigger(availableNow=True) if drain else writer
    return follow(spark, group, job, writer.start)


__all__ = [
    "backlog_progress",
    "latest_windows",
    "start_first_records",
    "start_lag_monitor",
    "start_list_feed",
    "start_message_feed",
    "start_message_monitor",
    "start_result_tail",
    "start_stream_sum",
]
