"""Reading and writing topics, as tables or at a broker."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.session import checkpoint_path, shared_dir
from tallyline.sources.commits import committed_offsets, follow, never_written, observe_offsets
from tallyline.sources.schemas import STORED_TOPIC, TOPIC
from tallyline.sources.spec import (
    Offsets,
    TopicSpec,
    batch_read_options,
    stream_read_options,
    write_options,
)

_LAYOUT = ("topic", "partition")
_PLACE = ("topic", "partition", "offset")

# Growing offsets are stored as differences, which takes a fraction of the
# space; a dictionary of values that never repeat only costs time.
_FILE_OPTIONS = {"parquet.writer.version": "v2", "parquet.enable.dictionary#offset": "false"}


def _topic_columns(df: DataFrame, topic: str) -> DataFrame:
    """One topic of a table. Columns its writer had nothing for are empty; a
    record without a time type was timed by its producer (0)."""
    kind = F.coalesce("timestampType", F.lit(0)).alias("timestampType")
    columns = [kind if n == "timestampType" else F.col(n) for n in STORED_TOPIC.names]
    return df.where(F.col("topic") == topic).select(*columns)


def _bounds(
    df: DataFrame, offsets: Offsets | None, compare, widest, partitions: list[int] | None
) -> DataFrame:
    """Rows on the right side of the offset named for their partition, if one
    is. Where every partition read has an offset, the widest of them is also
    asked for alone: in that form it reaches the statistics in the files."""
    if not offsets:
        return df
    if partitions is not None and set(partitions) <= set(offsets):
        df = df.where(compare(F.col("offset"), widest(offsets[p] for p in partitions)))
    named = reduce(
        Column.__or__,
        [(F.col("partition") == p) & compare(F.col("offset"), o) for p, o in offsets.items()],
    )
    return df.where(named | ~F.col("partition").isin(*offsets))


def read_topic_batch(
    spark: SparkSession,
    spec: TopicSpec,
    partitions: list[int] | None = None,
    start: Offsets | None = None,
    end: Offsets | None = None,
) -> DataFrame:
    """A bounded read: all partitions or the named ones, from ``start``
    (inclusive) to ``end`` (exclusive) where these name a partition."""
    if not spec.is_table:
        options = batch_read_options(spec, partitions, start, end)
        return spark.read.format("kafka").options(**options).load().select(*TOPIC.names)
    df = _topic_columns(spark.read.schema(STORED_TOPIC).parquet(spec.path), spec.topic)
    if partitions is not None:
        df = df.where(F.col("partition").isin(*partitions))
    df = _bounds(df, start, Column.__ge__, min, partitions)
    return _bounds(df, end, Column.__lt__, max, partitions)


def end_offsets(df: DataFrame) -> DataFrame:
    """One past the last record of every partition."""
    return df.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))


def track_ends(spark: SparkSession, spec: TopicSpec) -> Callable[[], DataFrame]:
    """``end_offsets`` of a table topic, to be asked for again and again: each
    call reads only from the ends of the call before, which skips all older
    parts of the files. Keeps one number per partition on the driver."""
    known: dict[int, int] = {}

    def ends() -> DataFrame:
        seen = list(known)
        older = read_topic_batch(spark, spec, partitions=seen, start=known)
        newer = read_topic_batch(spark, spec).where(~F.col("partition").isin(seen))
        fresh = end_offsets(older.select(*_PLACE).union(newer.select(*_PLACE)))
        known.update({row["partition"]: row["end"] for row in fresh.collect()})
        rows = [(spec.topic, partition, end) for partition, end in known.items()]
        return spark.createDataFrame(rows, "topic string, partition int, end bigint")

    return ends


def drop_repeats(df: DataFrame, within: str | None = None) -> DataFrame:
    """Each record once, where a sink may have delivered it again. A stream
    remembers records for the time ``within`` after the newest one."""
    if not df.isStreaming:
        return df.dropDuplicates(list(_PLACE))
    if within is None:
        raise ValueError("a stream needs a time to remember records for")
    return df.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(list(_PLACE))


def _first_offsets(spark: SparkSession, spec: TopicSpec, job: str) -> Offsets:
    """Where a group begins that has committed nothing yet. ``latest`` is
    looked up once and kept with the group, so that records which arrive while
    the job is down are not skipped at its next start."""
    if spec.start == "earliest":
        return {}
    if not isinstance(spec.start, str):
        return spec.start
    kept = f"{checkpoint_path(spark, spec.group, job)}/start"
    found = _kept_offsets(spark, kept)
    if found is None:
        _current_ends(spark, spec).coalesce(1).write.mode("overwrite").json(kept)
        found = _kept_offsets(spark, kept)
    return found


# Marks a list of first offsets as written to its end.
_COMPLETE = -1


def _current_ends(spark: SparkSession, spec: TopicSpec) -> DataFrame:
    schema = "partition int, end bigint"
    marker = spark.createDataFrame([(_COMPLETE, 0)], schema)
    try:
        present = end_offsets(read_topic_batch(spark, spec)).select("partition", "end")
    except AnalysisException as problem:
        never_written(problem)
        return marker
    return marker.union(present)


def _kept_offsets(spark: SparkSession, path: str) -> Offsets | None:
    try:
        rows = spark.read.schema("partition int, end bigint").json(path).collect()
    except AnalysisException as problem:
        never_written(problem)
        return None
    offsets = {row["partition"]: row["end"] for row in rows}
    return offsets if offsets.pop(_COMPLETE, None) is not None else None


def read_topic_stream(spark: SparkSession, spec: TopicSpec, job: str = "read") -> DataFrame:
    """A continuing read with the row layout of the bounded one. A table's offsets are
    observed, so that what the group has read can be noted.

    Where the group begins behind older records, the partitions it knows are asked for
    offsets from there on in a form that file statistics can answer, and partitions
    that came later are read as a source of their own, which no older file is in."""
    if not spec.is_table:
        options = stream_read_options(spec)
        return spark.readStream.format("kafka").options(**options).load().select(*TOPIC.names)
    reader = spark.readStream.schema(STORED_TOPIC).options(**spec.options)
    if spec.max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", spec.max_files_per_batch)

    def rows() -> DataFrame:
        return _topic_columns(reader.parquet(spec.path), spec.topic)

    first = _first_offsets(spark, spec, job)
    if not first:
        return observe_offsets(rows(), spec.partitions)
    named = F.col("partition").isin(*first)
    known = _bounds(rows().where(named), first, Column.__ge__, min, list(first))
    return observe_offsets(known.union(rows().where(~named)), spec.partitions)


def group_offsets(spark: SparkSession, spec: TopicSpec, job: str) -> DataFrame:
    """``committed_offsets`` of a group, from where it began."""
    first = _first_offsets(spark, spec, job)
    return committed_offsets(spark, spec, job, first)


def _ends_place(spark: SparkSession, spec: TopicSpec) -> str:
    name = hashlib.sha256(f"{spec.path}\n{spec.topic}".encode()).hexdigest()[:32]
    return f"{shared_dir(spark)}/tallyline/ends/{name}"


def _next_offset(spark: SparkSession, spec: TopicSpec) -> int:
    """One past the highest offset of a table topic. What was found is kept, and the
    next call reads on from there, which passes over all older parts of the files."""
    place = _ends_place(spark, spec)
    try:
        kept = spark.read.schema("end bigint").json(place).agg(F.max("end")).first()[0] or 0
    except AnalysisException as problem:
        never_written(problem)
        kept = 0
    try:
        last = newer_records(spark, spec, kept).agg(F.max("offset")).first()[0]
    except AnalysisException as problem:
        never_written(problem)
        return 0
    end = kept if last is None else last + 1
    if end > kept:
        noted = spark.createDataFrame([(end,)], "end bigint").coalesce(1)
        noted.write.mode("overwrite").json(place)
    return end


def newer_records(spark: SparkSession, spec: TopicSpec, end: int) -> DataFrame:
    """Places of the records at or beyond an offset, in all partitions."""
    rows = read_topic_batch(spark, spec)
    return rows.where(F.col("offset") >= end).select(*_PLACE)


def sink_rows(df: DataFrame, spec: TopicSpec) -> DataFrame:
    """Rows in the layout a table sink stores. Columns the frame lacks take the
    values a broker would give: the topic of the sink, one partition, the time
    of writing, and growing offsets (with gaps, which offsets may have). Key,
    time type and error are not stored for a frame that has none."""
    given = {
        "topic": F.lit(spec.topic),
        "partition": F.lit(0),
        "timestamp": F.current_timestamp(),
    }
    if "offset" not in df.columns:
        if df.isStreaming:
            raise ValueError("a stream into a table needs an offset that survives a restart")
        start = _next_offset(df.sparkSession, spec)
        given["offset"] = F.monotonically_increasing_id() + F.lit(start)
    given.update({name: F.col(name) for name in df.columns if name in STORED_TOPIC.names})
    return df.select(
        *[given[f.name].cast(f.dataType).alias(f.name) for f in STORED_TOPIC if f.name in given]
    )


def broker_rows(df: DataFrame, spec: TopicSpec) -> DataFrame:
    """Rows in the layout a broker sink takes. The origin of a set-aside row
    and the reason travel as record headers."""
    topic = F.col("topic") if "topic" in df.columns else F.lit(spec.topic)
    columns = [F.col("key") if "key" in df.columns else F.lit(None).cast("binary").alias("key")]
    columns += [F.col("value"), topic.alias("topic")]
    if "error" in df.columns:
        facts = [n for n in ("error", "partition", "offset") if n in df.columns]
        texts = {n: F.encode(F.col(n).cast("string"), "UTF-8") for n in facts}
        entries = [F.struct(F.lit(n).alias("key"), t.alias("value")) for n, t in texts.items()]
        columns.append(F.when(F.col("error").isNotNull(), F.array(*entries)).alias("headers"))
    return df.select(*columns)


def write_topic(df: DataFrame, spec: TopicSpec, spread: bool = False) -> None:
    """Append rows to a topic.

    ``spread`` first gathers the rows of each partition into few files, and
    lets Spark cut a partition with many rows into several tasks; without it
    every task writes the partitions it happens to hold and nothing is moved.
    """
    if not spec.is_table:
        options = write_options(spec)
        if "error" in df.columns:
            options["includeHeaders"] = "true"
        broker_rows(df, spec).write.format("kafka").options(**options).save()
        return
    rows = sink_rows(df, spec)
    if spread:
        rows = rows.hint("rebalance", *_LAYOUT).sortWithinPartitions(*_LAYOUT, "offset")
    writer = rows.write.mode("append").options(**_FILE_OPTIONS)
    writer.partitionBy(*_LAYOUT).parquet(spec.path)


def write_topic_stream(
    df: DataFrame, spec: TopicSpec, group: str, job: str, drain: bool = True
) -> StreamingQuery:
    """Append a continuing frame to a topic, with the group's progress kept in
    its checkpoint. ``drain`` stops once everything present has been read."""
    if spec.is_table:
        writer = sink_rows(df, spec).writeStream.format("parquet").partitionBy(*_LAYOUT)
        writer = writer.options(path=spec.path, **_FILE_OPTIONS)
    else:
        options = write_options(spec)
        if "error" in df.columns:
            options["includeHeaders"] = "true"
        writer = broker_rows(df, spec).writeStream.format("kafka").options(**options)
    writer = writer.outputMode("append").queryName(f"{group}.{job}")
    writer = writer.option(
        "checkpointLocation", f"{checkpoint_path(df.sparkSession, group, job)}/progress"
    )
    writer = writer.trigger(availableNow=True) if drain else writer
    return follow(df.sparkSession, group, job, writer.start)


def union_topics(*frames: DataFrame) -> DataFrame:
    """Rows of several producers as one topic."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def offsets_from_progress(spark: SparkSession, group: str, progress: dict) -> DataFrame:
    """Committed and newest offsets of a running broker query, one row per
    topic and partition, from its last progress report."""
    rows = []
    for source in progress["sources"]:
        read, newest = (
            json.loads(source[k]) if isinstance(source.get(k), str) else source.get(k) or {}
            for k in ("endOffset", "latestOffset")
        )
        for topic, partitions in read.items():
            for partition, offset in partitions.items():
                last = newest.get(topic, {}).get(partition, offset)
                rows.append((group, topic, int(partition), int(offset), int(last)))
    return spark.createDataFrame(
        rows, "group string, topic string, partition int, committed bigint, end bigint"
    )
