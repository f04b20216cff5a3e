"""What a group has committed, how far a job is, and folders that do not grow."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_streaming import GOOD, SCHEMA, lists, run, send, topic

from tallyline.operators.metrics import consumer_lag
from tallyline.plans import jobs
from tallyline.sources import commits, topics
from tallyline.sources.spec import TopicSpec
from tallyline.streaming import jobs as streams


def committed(spark, source, job="stream_sum"):
    found = topics.group_offsets(spark, source, job).collect()
    assert all(r["group"] == source.group and r["topic"] == "in" for r in found)
    return {r["partition"]: r["committed"] for r in found}


def lag(spark, source, job="stream_sum"):
    ends = topics.end_offsets(topics.read_topic_batch(spark, source))
    return consumer_lag(topics.group_offsets(spark, source, job), ends).first()["total_lag"]


def test_dropped_payloads_are_committed(spark):
    """The last records of every partition have no payload, so no result stands for them."""
    source, sink = topic(spark, "commits")
    rows = lists(0, 40) + [(None, None, i % 4, i, None) for i in range(40, 60)]
    send(spark, source, rows)
    run(streams.start_stream_sum(spark, source, sink))
    assert committed(spark, source) == {0: 57, 1: 58, 2: 59, 3: 60}
    assert lag(spark, source) == 0
    send(spark, source, [(None, GOOD, 2, 70, None), (None, None, 3, 90, None)])
    assert lag(spark, source) == 71 - 59 + 91 - 60
    run(streams.start_stream_sum(spark, source, sink))
    assert committed(spark, source) == {0: 57, 1: 58, 2: 71, 3: 91}
    # Nothing new, and another group of the same topic.
    run(streams.start_stream_sum(spark, source, sink))
    assert lag(spark, source) == 0
    other = TopicSpec("in", path=source.path, group=f"{source.group}-other", start="earliest")
    assert committed(spark, other) == {}


def test_a_group_that_began_late_has_committed_where_it_began(spark):
    source, sink = topic(spark, "late", start="latest")
    send(spark, source, lists(0, 40))
    run(streams.start_stream_sum(spark, source, sink))
    assert committed(spark, source) == {0: 37, 1: 38, 2: 39, 3: 40}
    assert lag(spark, source) == 0


def test_a_lost_note_is_made_up_by_the_next(spark):
    """Notes are taken in turn; one that was cut is not believed."""
    source, sink = topic(spark, "notes")
    for first in (0, 10, 20):
        send(spark, source, lists(first, first + 10), files=1)
        run(streams.start_stream_sum(spark, source, sink))
    assert committed(spark, source) == {0: 29, 1: 30, 2: 27, 3: 28}  # noted by now
    place = commits._place(spark, source.group, "stream_sum")
    cut = spark.createDataFrame([("end", 9, 0, 999, "")], commits._SCHEMA)
    cut.write.mode("overwrite").json(f"{place}/slot=0")
    assert max(committed(spark, source).values()) <= 30
    cut.write.mode("overwrite").json(f"{place}/slot=1")
    assert committed(spark, source) == {}
    send(spark, source, lists(30, 40), files=1)
    run(streams.start_stream_sum(spark, source, sink))
    assert committed(spark, source) == {0: 37, 1: 38, 2: 39, 3: 40}


def test_partitions_beyond_the_declared_ones_are_reported(spark):
    source, sink = topic(spark, "stray", partitions=2)
    send(spark, source, lists(0, 10))
    run(streams.start_stream_sum(spark, source, sink))
    with pytest.raises(ValueError, match="beyond"):
        committed(spark, source)


def test_ticks_of_a_backlog(spark):
    source, sink = topic(spark, "ticks", max_files_per_batch=1)
    send(spark, source, lists(0, 100), files=4)
    run(streams.start_stream_sum(spark, source, sink))
    ticks = streams.backlog_progress(spark, source, 100, "stream_sum").orderBy("batch").collect()
    assert len(ticks) > 3 and ticks[-1]["done"] == 100 and ticks[-1]["pct"] == 100
    done = 0
    for tick in ticks:
        done += tick["n"]
        assert (tick["done"], tick["pct"]) == (done, done)
    assert [t["tick"] for t in ticks] == sorted(t["tick"] for t in ticks)


def test_a_late_start_reads_no_older_records(spark):
    source, sink = topic(spark, "latest", start="latest", partitions=4)
    for first in range(0, 4000, 800):
        send(spark, source, lists(first, first + 800))
    # Of the files, only those of the last append can hold what may be new.
    query = run(streams.start_stream_sum(spark, source, sink))
    assert sum(p["numInputRows"] for p in query.recentProgress) <= 800
    assert topics.read_topic_batch(spark, source).count() == 4000
    send(spark, source, [(None, GOOD, p, 5000 + p, None) for p in (0, 1, 2, 3)] * 2)
    query = run(streams.start_stream_sum(spark, source, sink))
    assert sum(p["numInputRows"] for p in query.recentProgress) == 8
    # A partition that came later is read from its first record.
    wider = TopicSpec("in", path=source.path, group=source.group, start="latest", partitions=9)
    send(spark, source, [(None, GOOD, 8, 1, None)])
    run(streams.start_stream_sum(spark, wider, sink))
    assert committed(spark, wider)[8] == 2
    assert topics.read_topic_batch(spark, sink).count() == 9


def test_a_second_append_reads_on(spark):
    """Offsets grow over appends, and only those behind the kept end are looked at."""
    source, _ = topic(spark, "append")
    rows = spark.createDataFrame([(GOOD,)] * 20, "value binary")
    for _ in range(3):
        topics.write_topic(rows, source)
    found = topics.read_topic_batch(spark, source)
    assert found.select("offset").distinct().count() == 60
    end = topics._next_offset(spark, source)
    assert end == found.agg(F.max("offset")).first()[0] + 1
    newer = topics.newer_records(spark, source, end)
    plan = newer._jdf.queryExecution().toString()
    assert f"GreaterThanOrEqual(offset,{end})" in plan and newer.count() == 0
    kept = spark.read.json(topics._ends_place(spark, source))
    assert kept.first()["end"] == end
    empty, _ = topic(spark, "append-none")
    assert topics._next_offset(spark, empty) == 0


def tail_source(spark, name, batches):
    source, sink = topic(spark, name)
    results = TopicSpec("sums", path=sink.path, group=source.group, start="earliest", max_files_per_batch=1)
    for number in range(batches):
        rows = [
            (None, GOOD, 0, number * 10 + i, (number * 3 + i) % 40 + 0.5) for i in range(10)
        ]
        df = spark.createDataFrame(rows, SCHEMA.replace("timestamp timestamp", "s double"))
        df = df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s").coalesce(1)
        topics.write_topic(jobs.stream_sum(df, "sums"), results)
    return results, f"{sink.path}-tail"


def test_the_tail_folds_and_does_not_grow(spark):
    results, out = tail_source(spark, "fold", 11)
    run(streams.start_result_tail(spark, results, out, fold_every=2))
    whole = jobs.result_tail(topics.read_topic_batch(spark, results).drop("error"))
    expected = {(r["window_start"], r["n"]) for r in whole.collect()}

    def found():
        return {(r["window_start"], r["n"]) for r in streams.latest_windows(spark, out).collect()}

    assert found() == expected
    folders = {p.name for p in Path(out).glob("*/slot=*")}
    assert len(list(Path(out).glob("batch/slot=*"))) == 4
    assert folders == {f"slot={i}" for i in range(4)}
    # The fold of the last batch once more, as after a lost driver: the same state.
    again = streams._tail_state(spark, out, 10).collect()
    assert {(r["window_start"], r["n"]) for r in again} == expected


def test_exactly_n_from_a_stream(spark):
    """Cut within the batch that reaches the number; later batches, a second start and
    more records change nothing."""
    source, sink = topic(spark, "cut", max_files_per_batch=1)
    for part in range(5):
        send(spark, source, [(None, GOOD, 0, 10 * part + i, None) for i in range(10)], files=1)
    run(streams.start_first_records(spark, source, sink.path, 25))
    taken = spark.read.parquet(sink.path)
    assert taken.count() == 25 and taken.select("offset").distinct().count() == 25
    offsets = sorted(r["offset"] for r in taken.collect())
    by_batch = sorted(r["count"] for r in taken.groupBy("batch").count().collect())
    assert by_batch == [5, 10, 10]
    send(spark, source, [(None, GOOD, 0, 100 + i, None) for i in range(10)], files=1)
    run(streams.start_first_records(spark, source, sink.path, 25))
    again = sorted(r["offset"] for r in spark.read.parquet(sink.path).collect())
    assert again == offsets


def test_fewer_than_n_are_all_taken(spark):
    source, sink = topic(spark, "few")
    send(spark, source, [(None, GOOD, 0, i, None) for i in range(7)])
    run(streams.start_first_records(spark, source, sink.path, 25))
    assert spark.read.parquet(sink.path).count() == 7
