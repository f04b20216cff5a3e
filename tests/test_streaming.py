"""Jobs as streaming queries: same rows as in batch, nothing lost or doubled."""

from __future__ import annotations

import time

import pytest
import wire
from pyspark.sql import functions as F

from tallyline import session
from tallyline.operators.payloads import decode_messages, decode_sums
from tallyline.plans import jobs
from tallyline.sources.spec import TopicSpec
from tallyline.sources.topics import (
    drop_repeats,
    read_topic_batch,
    read_topic_stream,
    track_ends,
    write_topic,
    write_topic_stream,
)
from tallyline.streaming import jobs as streams

GOOD = wire.put_list([1, 2, 3])
SCHEMA = "key binary, value binary, partition int, offset bigint, timestamp timestamp"


def topic(spark, name, **settings):
    path = session.scratch_path(spark, name)
    settings = {"start": "earliest", "group": path.rsplit("/", 1)[-1], **settings}
    return TopicSpec("in", path=f"{path}/in", **settings), TopicSpec("sums", path=f"{path}/out")


def lists(first, last):
    """Records of which every seventh has no payload and every fifth is cut."""
    rows = []
    for i in range(first, last):
        payload = wire.put_list([i, -3 * i, 70])
        if i % 7 == 0:
            payload = None
        elif i % 5 == 0:
            payload = payload[:-1]
        key = None if i % 3 == 0 else b"k%d" % i
        rows.append((key, payload, i % 4, i, None))
    return rows


def send(spark, spec, rows, files=3):
    write_topic(spark.createDataFrame(rows, SCHEMA).repartition(files), spec)


def run(query):
    query.awaitTermination()
    return query


def sums_of(spark, sink):
    rows = decode_sums(read_topic_batch(spark, sink).drop("error")).collect()
    return sorted(
        (r["offset"], r["partition"], r["key"] and bytes(r["key"]), r["sum"]) for r in rows
    )


def expected_sums(rows):
    return sorted(
        (o, p, key, sum(wire.take_list(value)))
        for key, value, p, o, _ in rows
        if value is not None and wire.list_or_reason(value)[1] is None
    )


def expected_bad(rows):
    return sorted(
        (o, p, value, wire.list_or_reason(value)[1])
        for _, value, p, o, _ in rows
        if value is not None and wire.list_or_reason(value)[1] is not None
    )


def bad_of(spark, sink):
    rows = read_topic_batch(spark, TopicSpec(jobs.QUARANTINE, path=sink.path)).collect()
    return sorted((r["offset"], r["partition"], bytes(r["value"]), r["error"]) for r in rows)


def test_stream_equals_batch_and_brute_force(spark):
    source, sink = topic(spark, "equal", max_files_per_batch=2)
    rows = lists(0, 200)
    send(spark, source, rows)
    query = run(streams.start_stream_sum(spark, source, sink))
    assert sums_of(spark, sink) == expected_sums(rows)
    assert bad_of(spark, sink) == expected_bad(rows)
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) > 1  # the limit per batch holds
    seen = [p["observedMetrics"]["rows"] for p in batches]
    assert sum(s["n"] for s in seen) == 200
    assert sum(s["null_value"] for s in seen) == sum(r[1] is None for r in rows)

    batch = TopicSpec("sums", path=f"{sink.path}-batch")
    jobs.process_backlog(spark, source, batch)
    assert sums_of(spark, batch) == sums_of(spark, sink)
    assert bad_of(spark, batch) == bad_of(spark, sink)


def test_a_second_run_adds_nothing_and_new_rows_are_added_once(spark):
    source, sink = topic(spark, "resume")
    send(spark, source, lists(0, 60))
    for _ in range(2):
        run(streams.start_stream_sum(spark, source, sink))
        assert sums_of(spark, sink) == expected_sums(lists(0, 60))
    send(spark, source, lists(60, 90))
    run(streams.start_stream_sum(spark, source, sink))
    assert sums_of(spark, sink) == expected_sums(lists(0, 90))


def test_a_query_that_is_stopped_goes_on(spark):
    source, sink = topic(spark, "stopped", max_files_per_batch=1)
    rows = lists(0, 240)
    send(spark, source, rows, files=6)
    query = streams.start_stream_sum(spark, source, sink, drain=False)
    while not any(p["numInputRows"] for p in query.recentProgress):
        time.sleep(0.05)
    query.stop()
    run(streams.start_stream_sum(spark, source, sink))
    assert sums_of(spark, sink) == expected_sums(rows)


def test_groups_read_independently(spark):
    source, sink = topic(spark, "groups")
    send(spark, source, lists(0, 40))
    for name in "ab":
        mine = TopicSpec("in", path=source.path, group=f"{source.group}{name}", start="earliest")
        out = TopicSpec("sums", path=f"{sink.path}{name}")
        run(streams.start_stream_sum(spark, mine, out))
        assert sums_of(spark, out) == expected_sums(lists(0, 40))


def test_latest_skips_the_past_but_not_the_time_it_was_down(spark):
    source, sink = topic(spark, "latest", start="latest")
    send(spark, source, lists(0, 50))
    run(streams.start_stream_sum(spark, source, sink))
    send(spark, source, lists(50, 80))
    run(streams.start_stream_sum(spark, source, sink))
    send(spark, source, lists(80, 90))
    run(streams.start_stream_sum(spark, source, sink))
    assert sums_of(spark, sink) == expected_sums(lists(50, 90))


def test_named_first_offsets(spark):
    first = {0: 20, 1: 0, 3: 1000}
    source, sink = topic(spark, "named", start=first)
    send(spark, source, lists(0, 50))
    run(streams.start_stream_sum(spark, source, sink))
    kept = [r for r in lists(0, 50) if r[3] >= first.get(r[2], 0)]
    assert sums_of(spark, sink) == expected_sums(kept)


def test_message_monitor(spark):
    source, sink = topic(spark, "monitor")
    messages = [wire.put_message(i, 1.7e9 + i, f"Message {i}") for i in range(20)]
    messages[3] = messages[3][:-1]
    rows = [(None, m, 0, i, None) for i, m in enumerate(messages)]
    send(spark, source, rows)
    run(streams.start_message_monitor(spark, source, sink.path, F.col("event_time") + 2.0))
    seen = {r["offset"]: r for r in spark.read.parquet(sink.path).collect()}
    assert len(seen) == 20
    assert (seen[3]["outcome"], seen[3]["error"]) == ("quarantine", "truncated")
    assert seen[3]["line"] is None
    assert bytes(seen[3]["value"]) == messages[3]
    assert seen[5]["line"] == "New message: [ID=5] Message 5 at 1700000005.000"
    assert (seen[5]["latency_line"], seen[5]["value"]) == ("Latency: 2.000 seconds", None)


@pytest.mark.parametrize("policy", ["zero", "received"])
def test_monitor_with_a_policy_keeps_whole_messages(spark, policy):
    row = (b"", wire.put_message(4, 5.0, "x"), 0, 0, None)
    df = spark.createDataFrame([row], SCHEMA).withColumn("topic", F.lit("in"))
    df = df.withColumn("timestamp", F.timestamp_seconds(F.lit(8)))
    seen = jobs.message_monitor(df, policy=policy).first()
    assert (seen["message_id"], seen["event_time"], seen["latency"]) == (4, 5.0, 3.0)


def test_receipt_is_the_time_of_the_broker_or_the_clock(spark):
    row = (b"", wire.put_message(4, 5.0, "x"), 0, 0, None)
    df = spark.createDataFrame([row], SCHEMA).withColumn("topic", F.lit("in"))
    df = df.withColumn("timestamp", F.timestamp_seconds(F.lit(8)))
    for kind, near in ((1, 8.0), (0, time.time())):
        timed = df.withColumn("timestampType", F.lit(kind))
        for policy in (None, "zero"):
            seen = jobs.message_monitor(timed, policy=policy).first()
            assert abs(seen["received_time"] - near) < 60
            assert seen["latency"] == seen["received_time"] - 5.0


def test_result_tail(spark):
    source, sink = topic(spark, "tail", max_files_per_batch=1)
    rows = spark.range(90).select(
        F.lit(wire.put(5)).alias("value"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
        F.timestamp_seconds(F.col("id") % 12).alias("timestamp"),
    )
    write_topic(rows.repartition(3), source)
    out = f"{sink.path}-tail"
    run(streams.start_result_tail(spark, source, out))
    run(streams.start_result_tail(spark, source, out))
    found = streams.latest_windows(spark, out).collect()
    assert sorted((r["window_start"].second, r["n"], r["per_sec"]) for r in found) == [
        (0, 40, 8),
        (5, 36, 7),
        (10, 14, 2),
    ]


def test_result_tail_that_never_ran(spark):
    assert streams.latest_windows(spark, session.scratch_path(spark, "no_tail")).count() == 0


def wait_for(check, seconds=60):
    end = time.monotonic() + seconds
    while not check():
        assert time.monotonic() < end, "nothing came"
        time.sleep(0.2)


def stored(spark, spec):
    """The topic once something has been committed, else nothing."""
    try:
        return read_topic_batch(spark, spec).collect()
    except Exception:  # the table is not there yet
        return []


def test_message_feed(spark):
    _, sink = topic(spark, "feed")
    query = streams.start_message_feed(spark, sink, start_millis=1_700_000_000_000)
    wait_for(lambda: len(stored(spark, sink)) >= 4)
    query.stop()
    rows = decode_messages(read_topic_batch(spark, sink)).orderBy("message_id").collect()
    assert [(r["message_id"], r["content"]) for r in rows] == [
        (i, f"Message {i}") for i in range(len(rows))
    ]
    steps = {b["event_time"] - a["event_time"] for a, b in zip(rows, rows[1:], strict=False)}
    assert steps == {2.0}


def test_list_feed(spark):
    _, sink = topic(spark, "list_feed")
    query = streams.start_list_feed(spark, sink, rows_per_second=50)
    wait_for(lambda: len(stored(spark, sink)) >= 50)
    query.stop()
    rows = read_topic_batch(spark, sink).collect()
    assert len({r["offset"] for r in rows}) == len(rows)
    assert all(2 <= len(wire.take_list(bytes(r["value"]))) <= 5 for r in rows)


def test_a_stream_drops_repeats(spark):
    source, sink = topic(spark, "repeats", max_files_per_batch=1)
    for _ in range(2):
        write_topic(timed_rows(spark, 30), source)
    stream = drop_repeats(read_topic_stream(spark, source), within="1 hour")
    run(write_topic_stream(stream.withColumn("topic", F.lit("sums")), sink, source.group, "once"))
    assert sorted(r["offset"] for r in stored(spark, sink)) == list(range(30))


def timed_rows(spark, n):
    return spark.range(n).select(
        F.lit(GOOD).alias("value"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"),
    )


def test_lag_monitor(spark, capsys):
    source, _ = topic(spark, "lag")
    send(spark, source, lists(0, 10))
    committed = spark.createDataFrame(
        [("g", "in", p, 4) for p in range(4)],
        "group string, topic string, partition int, committed bigint",
    )
    query = streams.start_lag_monitor(
        spark,
        lambda: committed,
        track_ends(spark, source),
        groups=spark.createDataFrame([("g",), ("h",)], "group string"),
        every="1 second",
    )
    printed = []
    try:
        wait_for(lambda: printed.append(capsys.readouterr().out) or "Group 'h'" in "".join(printed))
    finally:
        query.stop()
    assert "Group: g | Total Lag: 18 messages" in "".join(printed)
    assert "Group 'h' not found or has no offsets..." in "".join(printed)


def test_backlog_run(spark):
    source, sink = topic(spark, "backlog", partitions=3)
    result = jobs.run_backlog(spark, source, sink, rows=5000)
    assert (result.rows, read_topic_batch(spark, sink).count()) == (5000, 5000)
    partitions = read_topic_batch(spark, sink).select("partition").distinct().collect()
    assert {r[0] for r in partitions} <= {0, 1, 2}
    row = jobs.run_row(spark, result, "local").first()
    assert row["total"] == 5000 and row["per_sec"] > 0


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    from tallyline.plans.tables import table_stream

    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/part")
    (one,) = (tmp_path / "part").glob("part-*.parquet")
    one.rename(tmp_path / "single.parquet")
    for name, rows in (("many", 30), ("single", 5)):
        stream = table_stream(spark, str(tmp_path), name)
        query = (
            stream.writeStream.format("memory").queryName(f"rows_of_{name}")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert spark.table(f"rows_of_{name}").count() == rows
