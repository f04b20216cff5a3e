"""Projections, figures and layout against plain Python on small tables."""

from __future__ import annotations

import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars
from tallyline.operators import layout, metrics, transforms
from tallyline.operators.payloads import drop_null_values, with_defaults

START = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def timed(spark, seconds, **columns):
    rows = [(at(s), *[c[i] for c in columns.values()]) for i, s in enumerate(seconds)]
    names = ", ".join(f"{name} int" for name in columns)
    return spark.createDataFrame(rows, "timestamp timestamp" + (f", {names}" if names else ""))


# Projections


def test_latency_from_topic_time_and_given_time(spark):
    df = spark.createDataFrame([(1704067200.0, at(2.5))], "event_time double, timestamp timestamp")
    assert transforms.with_latency(df).first()["latency"] == 2.5
    given = transforms.with_latency(df, F.lit(1704067201.0)).first()
    assert (given["received_time"], given["latency"]) == (1704067201.0, 1.0)


def test_latency_without_topic_time_uses_the_clock(spark):
    df = spark.createDataFrame([(0.0,)], "event_time double")
    assert transforms.with_latency(df).first()["latency"] > 1.7e9


@pytest.mark.parametrize(
    ("style", "time", "shown", "waited", "wait_shown"),
    [
        ("fixed", 1707744000.12, "1707744000.120", 1.5, "1.500"),
        ("rounded", 1707744000.12, "1707744000.12", 1.5, "1.5"),
        ("rounded", 1707744000.0, "1707744000.0", 100.0, "100.0"),
        ("rounded", 1707744000.123, "1707744000.123", 0.05, "0.05"),
    ],
)
def test_report_lines(spark, style, time, shown, waited, wait_shown):
    df = spark.createDataFrame(
        [(7, time, "Message 7", waited)],
        "message_id bigint, event_time double, content string, latency double",
    )
    row = transforms.format_report(df, style).first()
    assert row["line"] == f"New message: [ID=7] Message 7 at {shown}"
    assert row["latency_line"] == f"Latency: {wait_shown} seconds"


def test_unknown_style(spark):
    with pytest.raises(ValueError, match="style"):
        scalars.seconds_text(F.lit(1.0), "roman")


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.epoch_seconds(F.lit(at(0.25))).alias("seconds"),
        scalars.epoch_seconds_from_millis(F.lit(1500)).alias("from_millis"),
        scalars.message_content(F.lit(12)).alias("content"),
        scalars.per_second(F.lit(14), 5).alias("per_second"),
        scalars.percent_done(F.lit(2), F.lit(3)).alias("percent"),
        scalars.remaining(F.lit(5), F.lit(9)).alias("nothing"),
        scalars.remaining(F.lit(9), F.lit(5)).alias("something"),
    ).first()
    assert tuple(row) == (1704067200.25, 1.5, "Message 12", 2, 66, 0, 4)


def test_null_payloads_are_dropped(spark):
    df = spark.createDataFrame([(b"",), (None,), (b"x",)], "value binary")
    assert sorted(bytes(r[0]) for r in drop_null_values(df).collect()) == [b"", b"x"]


def test_defaults(spark):
    rows = [(None, None, None, 9.0, None), (3, 4.0, "c", 9.0, None), (None, None, None, 9.0, "bad")]
    df = spark.createDataFrame(
        rows,
        "message_id bigint, event_time double, content string, received_time double, error string",
    )
    zero = [tuple(r)[:3] for r in with_defaults(df, "zero").collect()]
    assert zero == [(0, 0.0, "Unknown"), (3, 4.0, "c"), (None, None, None)]
    received = [tuple(r)[:3] for r in with_defaults(df, "received").collect()]
    assert received == [(None, 9.0, None), (3, 4.0, "c"), (None, None, None)]
    with pytest.raises(ValueError, match="policy"):
        with_defaults(df, "guess")


# Figures


def random_seconds(n, span, seed=0):
    dice = random.Random(seed)
    return [dice.randrange(int(span * 1000)) / 1000 for _ in range(n)]


def test_throughput(spark):
    seconds = random_seconds(500, 60)
    expected = Counter(int(s // 5) * 5 for s in seconds)
    rows = metrics.throughput(timed(spark, seconds)).collect()
    found = {r["window_start"].replace(tzinfo=UTC): (r["n"], r["per_sec"], r["rate"]) for r in rows}
    assert found == {at(s): (n, n // 5, n / 5) for s, n in expected.items()}


def test_throughput_by_worker_reports_from_a_size_on(spark):
    df = timed(spark, [0, 2, 8, 0, 1, 0, 9], worker=[1, 1, 1, 2, 2, 3, 3])
    rows = metrics.throughput_by(df, "worker", min_rows=2, min_seconds=5).collect()
    assert sorted((r["worker"], r["n"], r["seconds"], r["per_sec"]) for r in rows) == [
        (1, 3, 8.0, 0),
        (3, 2, 9.0, 0),
    ]
    assert metrics.throughput_by(df, "worker").count() == 0


def test_throughput_by_worker_and_window(spark):
    df = timed(spark, [0, 2, 70, 71], worker=[1, 1, 1, 1])
    rows = metrics.throughput_by(df, "worker", window="1 minute", min_rows=1, min_seconds=0)
    assert sorted((r["n"], r["seconds"], r["per_sec"]) for r in rows.collect()) == [
        (2, 1.0, 2),
        (2, 2.0, 1),
    ]


def test_throughput_of_one_moment_has_no_rate(spark):
    row = metrics.throughput_by(
        timed(spark, [3, 3], worker=[1, 1]), "worker", min_rows=1, min_seconds=0
    ).first()
    assert (row["n"], row["seconds"], row["per_sec"]) == (2, 0.0, None)


def test_throughput_per_rows(spark):
    df = timed(spark, range(25), partition=[0] * 25)
    df = df.withColumn("offset", F.unix_seconds("timestamp") - 1704067200)
    rows = metrics.throughput_per_rows(df, rows=10).orderBy("report").collect()
    assert [(r["n"], r["last_offset"], r["seconds"]) for r in rows] == [(10, 9, 9.0), (10, 19, 9.0)]


@pytest.mark.parametrize("total", [None, 1000])
def test_progress(spark, total):
    seconds = random_seconds(400, 5 * 86400, seed=3)
    ticks = sorted(Counter(int(s // 3600) * 3600 for s in seconds).items())
    done, expected = 0, []
    for tick, n in ticks:
        done += n
        expected.append((at(tick), done, done * 100 // (total or 400)))
    rows = metrics.progress(timed(spark, seconds), total, tick="1 hour").orderBy("tick").collect()
    assert [(r["tick"].replace(tzinfo=UTC), r["done"], r["pct"]) for r in rows] == expected


def test_run_summary(spark):
    row = metrics.run_summary(timed(spark, [1, 3, 5])).first()
    assert (row["total"], row["seconds"], row["per_sec"]) == (3, 4.0, 0.75)
    alone = metrics.run_summary(timed(spark, [1])).first()
    assert (alone["total"], alone["seconds"], alone["per_sec"]) == (1, 0.0, None)


def lag_tables(spark):
    committed = spark.createDataFrame(
        [("a", "t", 0, 5), ("a", "t", 1, 20), ("b", "t", 0, 10), ("c", "t", 7, 1)],
        "group string, topic string, partition int, committed bigint",
    )
    ends = spark.createDataFrame(
        [("t", 0, 10), ("t", 1, 12)], "topic string, partition int, end bigint"
    )
    return committed, ends


def test_lag(spark):
    rows = metrics.consumer_lag(*lag_tables(spark)).collect()
    assert {r["group"]: (r["total_lag"], r["found"]) for r in rows} == {
        "a": (5, True),
        "b": (0, True),
        "c": (None, True),
    }


def test_lag_of_unknown_groups(spark):
    groups = spark.createDataFrame([("a",), ("nobody",)], "group string")
    lag = metrics.consumer_lag(*lag_tables(spark), groups)
    rows = metrics.lag_lines(lag.where("group <> 'c'")).collect()
    assert {r["group"]: (r["total_lag"], r["found"], r["line"]) for r in rows} == {
        "a": (5, True, "Group: a | Total Lag: 5 messages"),
        "nobody": (None, False, "Group 'nobody' not found or has no offsets..."),
    }


def test_counters(spark):
    df = spark.createDataFrame(
        [("t", 0, b"x"), ("t", 0, None), ("t", 1, b"")], "topic string, partition int, value binary"
    )
    rows = metrics.count_rows(df).collect()
    assert {r["partition"]: (r["n"], r["null_values"]) for r in rows} == {0: (2, 1), 1: (1, 0)}
    seen, figures = metrics.observe_rows(df)
    seen.write.format("noop").mode("overwrite").save()
    assert figures.get == {"n": 3, "null_value": 1}


# Layout


def scattered(spark, n, partitions, seed):
    """Order numbers with gaps, a third of them in partition 0."""
    dice = random.Random(seed)
    order = sorted(dice.sample(range(n * 4), n))
    rows = [(dice.randrange(partitions) if dice.randrange(3) else 0, o) for o in order]
    dice.shuffle(rows)
    return rows, spark.createDataFrame(rows, "partition int, id bigint").repartition(5)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_dense_offsets(spark, block):
    rows, df = scattered(spark, 300, 4, seed=1)
    expected = {}
    for partition in range(4):
        ids = sorted(o for p, o in rows if p == partition)
        expected.update({(partition, o): i for i, o in enumerate(ids)})
    found = layout.with_offsets(df, "id", block).collect()
    assert {(r["partition"], r["id"]): r["offset"] for r in found} == expected


def test_rows_without_order_stay(spark):
    df = spark.createDataFrame([(0, 5), (0, None), (None, 1)], "partition int, id bigint")
    rows = layout.with_offsets(df, "id").collect()
    assert len(rows) == 3
    assert [r["offset"] for r in rows if r["id"] == 5] == [0]


@pytest.mark.parametrize("n", [0, 1, 37, 150, 299, 300, 301])
@pytest.mark.parametrize("block", [1, 16, 1 << 18])
def test_first_records(spark, n, block):
    rows, df = scattered(spark, 300, 4, seed=2)
    found = layout.first_records(df.withColumnRenamed("id", "offset"), n, block).collect()
    assert sorted(tuple(r) for r in found) == sorted(rows)[:n]


def test_first_records_with_repeats(spark):
    rows = [(0, 1), (0, 2), (0, 2), (0, 2), (1, 0)]
    df = spark.createDataFrame(rows, "partition int, offset bigint")
    for n in range(6):
        found = layout.first_records(df, n, 2).collect()
        assert sorted(tuple(r) for r in found) == rows[:n]


def test_first_records_sorts_no_payloads(spark, tmp_path):
    df = spark.range(1000).selectExpr("0 AS partition", "id AS offset", "'x' AS value")
    df.write.parquet(str(tmp_path / "topic"))
    first = layout.first_records(spark.read.parquet(str(tmp_path / "topic")), 700, 100)
    text = first._jdf.queryExecution().toString()
    assert first.count() == 700
    assert "TakeOrderedAndProject" not in text and "Sort" not in text
    assert "LessThan(offset,699)" in text


def test_partition_of_a_key(spark):
    rows = [(i, None if i % 5 == 0 else b"k%d" % (i % 11)) for i in range(400)]
    df = layout.with_partition(spark.createDataFrame(rows, "i bigint, key binary"), 6, "key", "i")
    homes: dict = {}
    for row in df.collect():
        assert 0 <= row["partition"] < 6
        homes.setdefault(row["key"] and bytes(row["key"]), set()).add(row["partition"])
    assert len(homes.pop(None)) == 6
    assert all(len(home) == 1 for home in homes.values())


def test_reports_over_offsets_with_gaps(spark):
    """Offsets as the engine's own sink gives them: gaps between its tasks."""
    df = spark.range(800).select(
        (F.col("id") % 8).cast("int").alias("partition"),
        (F.col("id") * 8589934592 + F.col("id")).alias("offset"),
        F.timestamp_seconds("id").alias("timestamp"),
    )
    rows = metrics.throughput_per_rows(df, rows=10).collect()
    assert len(rows) == 80
    assert all(r["n"] == 10 and r["seconds"] == 72.0 for r in rows)


def test_small_windows_are_carried_on(spark):
    """A window below the limits reports together with the next ones."""
    seconds = [0, 10, 70, 130, 140, 150, 190, 250]
    df = timed(spark, seconds, worker=[7] * len(seconds))
    rows = metrics.throughput_by(df, "worker", window="1 minute", min_rows=3, min_seconds=5)
    found = [(r["window_start"].minute, r["n"], r["seconds"]) for r in rows.collect()]
    assert sorted(found) == [(0, 3, 70.0), (2, 3, 20.0)]


def test_hashed_order_numbers_make_few_blocks(spark):
    df = spark.range(4000).select(
        F.lit(0).alias("partition"), F.xxhash64("id").alias("order")
    )
    found = layout.with_offsets(df, "order", 500)
    assert [r["offset"] for r in found.orderBy("order").collect()] == list(range(4000))
    plan = found._jdf.queryExecution().toString()
    assert "_width" in plan


def test_crowded_order_numbers_make_even_blocks(spark):
    """Twenty thousand numbers in a row, one far away, and clusters on many scales."""
    crowded = spark.range(20_000).union(spark.createDataFrame([(10**15,)], "id long"))
    scales = spark.range(9_000).selectExpr("cast(pow(1.004, id) as bigint) + id AS id")
    rows = crowded.selectExpr("0 AS partition", "id").union(scales.selectExpr("1", "id"))
    blocked, keys = layout.order_blocks(rows, "id", 256)
    sizes = blocked.groupBy(*keys).count()
    assert sizes.agg(F.max("count")).first()[0] <= 512
    found = layout.with_offsets(rows, "id", 256).orderBy("partition", "id").collect()
    expected = [(0, i) for i in range(20_001)] + [(1, i) for i in range(9_000)]
    assert [(r["partition"], r["offset"]) for r in found] == expected


def test_numbers_that_cannot_be_told_apart_end_the_cutting(spark):
    """Doubles of large numbers are equal; repeated numbers are never cut."""
    near = spark.range(3000).selectExpr("0 AS partition", f"{2**62} + id AS id")
    same = spark.range(3000).selectExpr("1 AS partition", "7L AS id")
    found = layout.with_offsets(near.union(same), "id", 10).orderBy("partition", "id")
    rows = found.collect()
    assert [r["offset"] for r in rows[:3000]] == list(range(3000))
    assert sorted(r["offset"] for r in rows[3000:]) == list(range(3000))


def test_rows_without_order_do_not_meet(spark):
    df = spark.range(400).selectExpr("0 AS partition", "cast(null AS bigint) AS id")
    found = layout.with_offsets(df.repartition(8), "id")
    assert found.where("offset IS NULL").count() == 400
    assert "_spare" in found._jdf.queryExecution().toString()


def brute_carried(windows, min_rows, min_seconds):
    found, carried = [], None
    for start, n, low, high in sorted(windows):
        carried = (start, n, low) if carried is None else (carried[0], carried[1] + n, carried[2])
        if carried[1] >= min_rows and high - carried[2] >= min_seconds:
            found.append((carried[0], carried[1], high - carried[2]))
            carried = None
    return found


@pytest.mark.parametrize("min_rows, min_seconds", [(1, 0), (4, 20), (9, 300), (10**6, 0)])
def test_carried_windows_equal_brute_force(spark, min_rows, min_seconds):
    dice = random.Random(min_rows)
    rows = [(dice.choice(["a", "b", None]), dice.randrange(400_000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "worker string, s long")
    df = df.withColumn("timestamp", F.timestamp_seconds("s"))
    found = metrics.throughput_by(
        df, "worker", window="1 minute", min_rows=min_rows, min_seconds=min_seconds
    )
    expected = []
    for worker in ("a", "b", None):
        windows: dict = {}
        for w, s in rows:
            if w == worker:
                windows.setdefault(s // 60 * 60, []).append(s)
        each = [(start, len(x), min(x), max(x)) for start, x in windows.items()]
        expected += [(worker, *r) for r in brute_carried(each, min_rows, min_seconds)]
    got = [
        (r["worker"], int(r["window_start"].timestamp()), r["n"], int(r["seconds"]))
        for r in found.withColumn("window_start", F.col("window_start")).collect()
    ]
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_many_windows_of_one_worker_are_several_tasks(spark):
    """A million windows of five seconds, every tenth of them enough by itself."""
    n = 1_000_000
    windows = spark.range(n).select(
        F.lit(1).alias("worker"),
        F.timestamp_seconds(F.col("id") * 5).alias("window_start"),
        F.when(F.col("id") % 10 == 9, 50).otherwise(1).cast("bigint").alias("n"),
        (F.col("id") * 5_000_000).alias("low"),
        (F.col("id") * 5_000_000 + 4_000_000).alias("high"),
    )
    segments = metrics._segments(windows, "worker", 50, 4)
    dealt = segments.repartition(4, "worker", "segment")
    tasks = dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < n / 2
    reports = metrics._carried(segments, "worker", 50, 4)
    found = reports.agg(F.count("*"), F.sum("n"), F.min("n"), F.max("n")).first()
    assert tuple(found) == (n // 10, 59 * (n // 10), 59, 59)


def test_lag_without_an_end_has_its_own_line(spark):
    lag = spark.createDataFrame([("g", None, True)], "group string, total_lag long, found boolean")
    assert metrics.lag_lines(lag).first()["line"] == "Group: g | Total Lag: unknown"
