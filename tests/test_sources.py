"""Topic settings, record schemas, generators, and topics in table form."""

from __future__ import annotations

import json

import pytest
import wire
from pyspark.sql import functions as F

from tallyline import session
from tallyline.operators.payloads import decode_int_lists, decode_messages, decode_topic
from tallyline.sources import generators, schemas, spec, topics
from tallyline.sources.spec import TopicSpec

BROKER = TopicSpec("t", servers="host:1", group="g", max_rows_per_batch=500)


def record(*types, names="abc"):
    fields = [{"name": n, "type": t} for n, t in zip(names, types, strict=False)]
    return {"type": "record", "name": "R", "fields": fields}


LIST = {"type": "array", "items": "int"}


# Settings


@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"path": "p", "servers": "s"},
        {"path": "p", "delivery": "maybe"},
        {"path": "p", "start": "yesterday"},
        {"path": "p", "partitions": 0},
        {"path": "p", "max_rows_per_batch": 5},
        {"servers": "s", "max_files_per_batch": 5},
    ],
)
def test_bad_settings(settings):
    with pytest.raises(ValueError):
        TopicSpec("t", **settings)


def test_subscription_options():
    assert spec.stream_read_options(BROKER) == {
        "kafka.bootstrap.servers": "host:1",
        "subscribe": "t",
        "startingOffsets": "latest",
        "groupIdPrefix": "g",
        "kafka.fetch.min.bytes": "1000000",
        "maxOffsetsPerTrigger": "500",
    }


def test_explicit_first_offsets_and_extra_options():
    named = TopicSpec(
        "t", servers="h", start={1: 7, 0: -2}, options={"minPartitions": "64"}, partitions=2
    )
    options = spec.stream_read_options(named)
    assert json.loads(options["startingOffsets"]) == {"t": {"0": -2, "1": 7}}
    assert options["minPartitions"] == "64"


def test_bounded_read_options():
    whole = spec.batch_read_options(BROKER)
    assert (whole["subscribe"], whole["startingOffsets"], whole["endingOffsets"]) == (
        "t",
        "earliest",
        "latest",
    )
    part = spec.batch_read_options(BROKER, partitions=[2, 0], start={0: 5}, end={2: 9})
    assert json.loads(part["assign"]) == {"t": [0, 2]}
    assert json.loads(part["startingOffsets"]) == {"t": {"0": 5, "2": -2}}
    assert json.loads(part["endingOffsets"]) == {"t": {"0": -1, "2": 9}}


def test_offsets_of_some_partitions():
    """Spark wants all partitions of a topic named; the others are read whole."""
    three = TopicSpec("t", servers="h", start={1: 7}, partitions=3)
    options = spec.stream_read_options(three)
    assert json.loads(options["startingOffsets"]) == {"t": {"0": -2, "1": 7, "2": -2}}
    part = spec.batch_read_options(three, start={1: 7}, end={0: 3})
    assert part["subscribe"] == "t"
    assert json.loads(part["startingOffsets"]) == {"t": {"0": -2, "1": 7, "2": -2}}
    assert json.loads(part["endingOffsets"]) == {"t": {"0": 3, "1": -1, "2": -1}}
    one = spec.batch_read_options(three, partitions=[1], start={0: 5, 1: 7})
    assert json.loads(one["startingOffsets"]) == {"t": {"1": 7}}


@pytest.mark.parametrize(
    ("delivery", "acks", "idempotent"),
    [("best_effort", "0", "false"), ("leader", "1", "false"), ("durable", "all", "true")],
)
def test_delivery_modes(delivery, acks, idempotent):
    options = spec.write_options(TopicSpec("t", servers="h", delivery=delivery))
    assert options["kafka.acks"] == acks
    assert options["kafka.enable.idempotence"] == idempotent


def test_settings_from_the_environment():
    assert spec.message_topic_from_env({}) == TopicSpec(
        "my-topic-1", servers="127.0.0.1:9094", group="my-group-1", delivery="durable"
    )
    env = {
        "KAFKA_BOOTSTRAP_SERVERS": "h:9",
        "INPUT_TOPIC": "i",
        "OUTPUT_TOPIC": "o",
        "APPLICATION_ID": "app",
        "DURABLE": "1",
    }
    source, sink = spec.sum_topics_from_env(env)
    assert (source.topic, source.group, source.start) == ("i", "app", "earliest")
    assert (sink.topic, sink.servers, sink.delivery) == ("o", "h:9", "durable")
    assert spec.sum_topics_from_env({})[1].delivery == "leader"


def test_broker_rows_carry_the_reason_as_headers(spark):
    df = spark.createDataFrame(
        [(b"k", b"v", "sums", 1, 5, None), (None, b"x", "quarantine", 2, 6, "truncated")],
        "key binary, value binary, topic string, partition int, offset bigint, error string",
    )
    good, bad = topics.broker_rows(df, BROKER).collect()
    assert good["headers"] is None and good["topic"] == "sums"
    headers = {h["key"]: bytes(h["value"]) for h in bad["headers"]}
    assert headers == {"error": b"truncated", "partition": b"2", "offset": b"6"}
    bare = topics.broker_rows(df.select("value"), BROKER).first()
    assert (bare["key"], bytes(bare["value"]), bare["topic"]) == (None, b"v", "t")


def test_offsets_from_a_progress_report(spark):
    report = {
        "sources": [
            {"endOffset": {"t": {"0": 5, "1": 8}}, "latestOffset": {"t": {"0": 9}}},
            {"endOffset": json.dumps({"u": {"0": 1}}), "latestOffset": None},
        ]
    }
    rows = topics.offsets_from_progress(spark, "g", report).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("g", "t", 0, 5, 9),
        ("g", "t", 1, 8, 8),
        ("g", "u", 0, 1, 1),
    ]


# Shared folder


def test_the_session_names_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named
    assert session.checkpoint_path(spark, "g", "j").startswith(named)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


class _Cluster:
    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster())


# Record schemas


def test_record_kinds():
    assert schemas.record_kind(record(LIST)) == schemas.INT_LIST
    assert schemas.record_kind(json.dumps(record("long"))) == schemas.SUM
    assert schemas.record_kind(record("long", "double", "string")) == schemas.MESSAGE
    assert schemas.record_kind(record("double")) == schemas.ANY
    assert schemas.record_fields(record(["string", "null"], {"type": "fixed", "size": 3})) == [
        ("a", (1, "string")), ("b", ("fixed", 3)),
    ]


@pytest.mark.parametrize(
    "avsc",
    [
        record("fixed"), {"type": "enum"}, record(["null", "int", "long"]), record(["null"]),
        record({"type": "array", "items": ["null", "int"]}), record({"type": "map", "values": "int"}),
        {"type": "record", "fields": []},
        {"type": "record", "fields": [{"name": "error", "type": "long"}]},
    ],
)
def test_unknown_records(avsc):
    with pytest.raises(ValueError):
        schemas.record_kind(avsc)


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_typed_reads(spark, engine):
    def read(payload, avsc):
        df = spark.createDataFrame([(bytearray(payload),)], "value binary")
        return decode_topic(df, avsc, engine=engine).drop("value").first().asDict()

    assert read(wire.put_list([1, 2]), record(LIST)) == {"a": [1, 2], "error": None}
    assert read(wire.put(-9), record("long")) == {"a": -9, "error": None}
    message = read(wire.put_message(4, 0.5, "x"), record("long", "double", "string"))
    assert message == {"a": 4, "b": 0.5, "c": "x", "error": None}


# Generators


def test_generated_lists(spark):
    df = generators.gen_int_lists(spark, 20_000, seed=3)
    lists = [r["numbers"] for r in decode_int_lists(df).select("numbers").collect()]
    assert len(lists) == 20_000
    assert {len(n) for n in lists} == {2, 3, 4, 5}
    assert {x for n in lists for x in n} == set(range(100))
    assert abs(sum(map(len, lists)) / 20_000 - 3.5) < 0.05
    assert abs(sum(map(sum, lists)) / 20_000 - 173.25) < 3


def test_generated_lists_depend_on_the_seed_alone(spark):
    def values(seed, tasks):
        df = generators.gen_int_lists(spark, 500, seed, tasks)
        return {r["id"]: bytes(r["value"]) for r in df.collect()}

    assert values(1, 2) == values(1, 7)
    assert values(1, 2) != values(2, 2)


def test_generated_messages(spark):
    df = generators.gen_messages(spark, 4, t0=1704067200.5).orderBy("message_id")
    rows = decode_messages(df.select("value", "timestamp")).collect()
    assert [(r["message_id"], r["event_time"], r["content"]) for r in rows] == [
        (i, 1704067200.5 + 2 * i, f"Message {i}") for i in range(4)
    ]
    assert [r["timestamp"].second for r in rows] == [0, 2, 4, 6]


# Topics as tables


def rows_of(df):
    return sorted((r["partition"], r["offset"], bytes(r["value"])) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark):
    topic = TopicSpec("t", path=session.scratch_path(spark, "stored"))
    rows = [(p, o, bytearray(b"%d-%d" % (p, o))) for p in range(3) for o in range(20)]
    df = spark.createDataFrame(rows, "partition int, offset bigint, value binary")
    topics.write_topic(df, topic, spread=True)
    topics.write_topic(df.limit(1), TopicSpec("other", path=topic.path))
    return topic, [(p, o, bytes(v)) for p, o, v in rows]


def test_stored_rows_come_back_with_broker_columns(spark, stored):
    topic, rows = stored
    df = topics.read_topic_batch(spark, topic)
    assert df.columns == schemas.STORED_TOPIC.names
    assert rows_of(df) == rows
    assert {r["key"] for r in df.collect()} == {None}


@pytest.mark.parametrize(
    ("partitions", "start", "end"),
    [
        (None, None, None),
        ([1], None, None),
        ([0, 2], {0: 5, 2: 7}, {0: 9, 2: 8}),
        ([0, 2], {0: 5}, {2: 8}),
        (None, {1: 19}, {0: 1}),
        ([], None, None),
    ],
)
def test_bounded_reads(spark, stored, partitions, start, end):
    topic, rows = stored
    expected = [
        (p, o, v)
        for p, o, v in rows
        if (partitions is None or p in partitions)
        and o >= (start or {}).get(p, 0)
        and o < (end or {}).get(p, 99)
    ]
    assert rows_of(topics.read_topic_batch(spark, topic, partitions, start, end)) == expected


def test_end_offsets(spark, stored):
    ends = topics.end_offsets(topics.read_topic_batch(spark, stored[0])).collect()
    found = {(r["topic"], r["partition"]): r["end"] for r in ends}
    assert found == {("t", p): 20 for p in range(3)}


def test_tracked_ends_follow_new_rows_and_partitions(spark):
    topic = TopicSpec("t", path=session.scratch_path(spark, "tracked"))

    def send(*places):
        rows = [(p, o, b"x") for p, o in places]
        df = spark.createDataFrame(rows, "partition int, offset bigint, value binary")
        topics.write_topic(df, topic)

    ends = topics.track_ends(spark, topic)
    send((0, 0), (0, 1), (1, 0))
    for new, expected in [
        ([], {0: 2, 1: 1}),
        ([(1, 1), (1, 2)], {0: 2, 1: 3}),
        ([(0, 2), (2, 0), (2, 7)], {0: 3, 1: 3, 2: 8}),
    ]:
        if new:
            send(*new)
        assert {r["partition"]: r["end"] for r in ends().collect()} == expected


def test_repeats_are_dropped(spark, stored):
    topic, rows = stored
    df = topics.read_topic_batch(spark, topic)
    assert rows_of(topics.drop_repeats(df.union(df).union(df.limit(5)))) == rows
    feed = spark.readStream.format("rate").load().withColumnRenamed("value", "offset")
    with pytest.raises(ValueError, match="remember"):
        topics.drop_repeats(feed)


def test_offsets_grow_over_writes(spark):
    topic = TopicSpec("t", path=session.scratch_path(spark, "grow"))
    text = F.encode(F.col("id").cast("string"), "UTF-8")
    values = spark.range(0, 100, 1, 3).select(text.alias("value"))
    for _ in range(3):
        topics.write_topic(values, topic)
    offsets = [r["offset"] for r in topics.read_topic_batch(spark, topic).collect()]
    assert len(offsets) == len(set(offsets)) == 300


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(b"x", 1)], "value binary, partition int")
    b = spark.createDataFrame([(b"y",)], "value binary")
    both = topics.union_topics(a, b, b).collect()
    assert sorted((bytes(r["value"]), r["partition"]) for r in both) == [
        (b"x", 1),
        (b"y", None),
        (b"y", None),
    ]


def test_a_stream_into_a_table_needs_offsets(spark):
    feed = spark.readStream.format("rate").load().select(F.lit(b"x").alias("value"))
    with pytest.raises(ValueError, match="offset"):
        topics.sink_rows(feed, TopicSpec("t", path="unused"))
