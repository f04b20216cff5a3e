"""The physical plans of the jobs: no shuffle where none is needed, one call of
each decoder, filters in the scan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyline import session
from tallyline.operators import metrics
from tallyline.operators.payloads import decode_messages, sum_int_lists
from tallyline.plans import jobs, queries, tables
from tallyline.sources.spec import TopicSpec
from tallyline.sources.topics import read_topic_batch, write_topic


def plan(df, run=False):
    execution = df._jdf.queryExecution()
    if run:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return execution.executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    spec = TopicSpec("events", path=session.scratch_path(spark, "plans"))
    write_topic(tables.event_messages(spark, sf_dir), spec)
    return spec


def test_stream_sum_moves_no_rows(spark, events):
    text = plan(jobs.stream_sum(read_topic_batch(spark, events)))
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1
    assert "PushedFilters: [IsNotNull(value)]" in text


def test_message_monitor_moves_no_rows(spark, events):
    text = plan(jobs.message_monitor(read_topic_batch(spark, events)))
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1


def test_testing_for_errors_decodes_once(spark, events):
    good = sum_int_lists(read_topic_batch(spark, events)).where("error IS NULL")
    assert plan(good.select("sum")).count("ArrowEvalPython") == 1


def test_only_needed_columns_are_read(spark, events):
    text = plan(decode_messages(read_topic_batch(spark, events)).select("message_id"))
    assert re.search(r"ReadSchema: struct<value:binary>", text)


def test_bounded_reads_prune_partitions_and_offsets(spark, events):
    df = read_topic_batch(spark, events, partitions=[1, 2], start={1: 10, 2: 5}, end={1: 50, 2: 90})
    df = df.select("value")
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "partition#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "(offset" in text
    explained = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = next(line for line in explained.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(offset,5)" in pushed
    assert "LessThan(offset,90)" in pushed


def test_counts_are_combined_before_the_shuffle(spark, events):
    for df in (
        metrics.throughput(read_topic_batch(spark, events)),
        metrics.count_rows(read_topic_batch(spark, events)),
        metrics.run_summary(read_topic_batch(spark, events)),
    ):
        text = plan(df)
        assert text.count("Exchange") == 1
        assert "partial_count" in text


def test_lag_joins_by_broadcast_when_the_tables_are_small(spark):
    ends = spark.range(8).select(
        F.lit("t").alias("topic"), F.col("id").alias("partition"), F.lit(9).alias("end")
    )
    group, read = F.lit("g").alias("group"), F.lit(3).alias("committed")
    committed = ends.select(group, "topic", "partition", read)
    assert "BroadcastHashJoin" in plan(metrics.consumer_lag(committed, ends))


def test_progress_reads_the_topic_once(spark, events):
    df = metrics.progress(read_topic_batch(spark, events), tick="1 hour")
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_a_large_partition_is_written_by_several_tasks(spark):
    """Two thirds of the rows in one partition: more than one file for it."""
    spec = TopicSpec("hot", path=session.scratch_path(spark, "hot"))
    rows = spark.range(0, 60_000, 1, 6).select(
        F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("value"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 4 + 1).otherwise(0).alias("partition"),
        F.col("id").alias("offset"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        write_topic(rows, spec, spread=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = read_topic_batch(spark, spec).withColumn("file", F.input_file_name())
    files = stored.groupBy("partition").agg(F.count_distinct("file").alias("files")).collect()
    assert {r["partition"]: r["files"] > 1 for r in files}[0]
    assert stored.count() == 60_000


def test_no_query_has_a_cross_product_of_rows(spark, sf_dir):
    for name, query in queries.QUERIES.items():
        if name in ("independent_groups", "latest_start", "lag_of_running_job"):
            continue  # these run streams first
        if name.endswith(("streaming", "resumed")):
            continue
        text = plan(query(spark, sf_dir))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name
