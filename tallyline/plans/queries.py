"""The registered queries: every operator over the given tables.

Each takes (spark, sf_dir). ``plans.oracles`` states the answer of each one in
SQL, straight from the tables, without topics and payloads.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.scalars import epoch_seconds, to_timestamp
from tallyline.operators.layout import first_records, with_offsets, with_partition
from tallyline.operators.metrics import (
    consumer_lag,
    count_rows,
    lag_lines,
    observe_rows,
    progress,
    run_summary,
    throughput,
    throughput_by,
    throughput_per_rows,
)
from tallyline.operators.payloads import (
    decode_int_lists,
    decode_messages,
    decode_sums,
    decode_topic,
    encode_records,
    encode_sums,
    list_sum,
    split_quarantine,
    sum_int_lists,
    with_defaults,
)
from tallyline.operators.transforms import format_report, with_latency
from tallyline.plans import jobs
from tallyline.plans.tables import (
    PARTITIONS,
    dense_events,
    document_lists,
    document_messages,
    event_messages,
    from_text_key,
    instant,
    lineitem_lists,
    order_messages,
    partition_of,
    table,
    table_stream,
    text_key,
)
from tallyline.session import scratch_path
from tallyline.sources.generators import with_message, with_random_list
from tallyline.sources.spec import TopicSpec
from tallyline.sources.topics import (
    drop_repeats,
    end_offsets,
    group_offsets,
    read_topic_batch,
    track_ends,
    union_topics,
    write_topic,
    write_topic_stream,
)
from tallyline.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Record schemas as a user would hand them in.
LIST_SCHEMA = {
    "type": "record",
    "name": "Basket",
    "fields": [{"name": "basket", "type": {"type": "array", "items": "int"}}],
}
SUM_SCHEMA = {
    "type": "record",
    "name": "Total",
    "fields": [{"name": "total", "type": "long"}],
}
MESSAGE_SCHEMA = {
    "type": "record",
    "name": "Note",
    "fields": [
        {"name": "note_id", "type": "long"},
        {"name": "sent_at", "type": "double"},
        {"name": "body", "type": "string"},
    ],
}

EVENT_SCHEMA = {
    "type": "record",
    "name": "Event",
    "fields": [
        {"name": "id", "type": "long"},
        {"name": "kind", "type": "string"},
        {"name": "note", "type": ["null", "string"]},
        {"name": "weight", "type": "double"},
        {"name": "alert", "type": "boolean"},
        {"name": "links", "type": {"type": "array", "items": "long"}},
        {"name": "sent", "type": ["long", "null"]},
    ],
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _specs(spark: SparkSession, name: str, **settings) -> tuple[TopicSpec, TopicSpec]:
    """A fresh input topic and a fresh output topic in the shared folder."""
    at = scratch_path(spark, name)
    group = at.rsplit("/", 1)[-1]
    settings = {"group": group, "start": "earliest", **settings}
    return (
        TopicSpec("in", path=f"{at}/in", **settings),
        TopicSpec(jobs.SUMS, path=f"{at}/out", group=group),
    )


def _drained(stream) -> None:
    stream.awaitTermination()


def _no_zone(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


def _as_topic(df: DataFrame, spec: TopicSpec) -> DataFrame:
    return df.withColumn("topic", F.lit(spec.topic))


# Stream sum ----------------------------------------------------------------


def _key_sums(routed: DataFrame) -> DataFrame:
    return decode_sums(routed).select(from_text_key().alias("l_orderkey"), "sum")


@query
def stream_sum(spark, sf_dir):
    """Lists in, one sum per record out, keys kept."""
    return _key_sums(jobs.stream_sum(lineitem_lists(spark, sf_dir)))


@query
def stream_sum_sql_engine(spark, sf_dir):
    """The same with lists decoded by plain expressions: a second opinion, which
    takes several times as long."""
    routed = jobs.stream_sum(lineitem_lists(spark, sf_dir), engine="sql")
    return decode_sums(routed, engine="sql").select(from_text_key().alias("l_orderkey"), "sum")


@query
def stream_sum_by_key(spark, sf_dir):
    sums = _key_sums(jobs.stream_sum(lineitem_lists(spark, sf_dir)))
    return sums.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("records"), F.sum("sum").alias("sum")
    )


@query
def stream_sum_documents(spark, sf_dir):
    """Long lists: the word lengths of whole documents."""
    routed = jobs.stream_sum(document_lists(spark, sf_dir))
    return decode_sums(routed).select(from_text_key().alias("doc_id"), "sum")


@query
def stream_sum_tables(spark, sf_dir):
    """From a topic table to a topic table, both on disk."""
    source, sink = _specs(spark, "stream_sum_tables")
    write_topic(_as_topic(lineitem_lists(spark, sf_dir), source).drop("offset"), source)
    jobs.process_backlog(spark, source, sink)
    return _key_sums(read_topic_batch(spark, sink))


@query
def stream_sum_streaming(spark, sf_dir):
    """The same as a streaming query that drains the topic, four files at a time."""
    source, sink = _specs(spark, "stream_sum_streaming", max_files_per_batch=4)
    write_topic(_as_topic(lineitem_lists(spark, sf_dir), source).drop("offset"), source)
    _drained(streams.start_stream_sum(spark, source, sink))
    return _key_sums(read_topic_batch(spark, sink))


@query
def stream_sum_resumed(spark, sf_dir):
    """Two producers write one after the other; the job runs after each and
    once more at the end. Nothing is lost, nothing is summed twice."""
    source, sink = _specs(spark, "stream_sum_resumed")
    lines = _as_topic(lineitem_lists(spark, sf_dir, "l_linestatus"), source).drop("offset")
    first = F.col("l_linestatus").eqNullSafe("O")
    for producer in (first, ~first):
        write_topic(lines.where(producer), source)
        _drained(streams.start_stream_sum(spark, source, sink))
    _drained(streams.start_stream_sum(spark, source, sink))
    return _key_sums(read_topic_batch(spark, sink))


@query
def independent_groups(spark, sf_dir):
    """Two consumer groups each see every record of a topic."""
    source, sink = _specs(spark, "independent_groups")
    write_topic(_as_topic(lineitem_lists(spark, sf_dir), source).drop("offset"), source)
    results = []
    for name in ("first", "second"):
        mine = TopicSpec("in", path=source.path, group=f"{source.group}-{name}", start="earliest")
        out = TopicSpec(jobs.SUMS, path=f"{sink.path}-{name}")
        _drained(streams.start_stream_sum(spark, mine, out))
        results.append(_key_sums(read_topic_batch(spark, out)).withColumn("group", F.lit(name)))
    return (
        union_topics(*results)
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("records"), F.sum("sum").alias("total"))
    )


@query
def backlog(spark, sf_dir):
    """Load, flush, process; then the summary of the result topic by the times
    of its records."""
    source, sink = _specs(spark, "backlog")
    write_topic(_as_topic(lineitem_lists(spark, sf_dir), source).drop("offset"), source)
    jobs.process_backlog(spark, source, sink)
    results = decode_sums(read_topic_batch(spark, sink))
    return run_summary(results, more=(F.sum("sum").alias("sum_of_sums"),))


@query
def backlog_progress(spark, sf_dir):
    """The same backlog as a streaming job, a few files at a time: after its last batch
    all is done, and no tick is behind the one before."""
    source, sink = _specs(spark, "backlog_progress", max_files_per_batch=4)
    write_topic(_as_topic(lineitem_lists(spark, sf_dir), source).drop("offset"), source)
    total = read_topic_batch(spark, source).count()
    _drained(streams.start_stream_sum(spark, source, sink))
    ticks = streams.backlog_progress(spark, source, total, "stream_sum")
    steps = ticks.select("*", F.lag("pct").over(Window.orderBy("batch")).alias("_before"))
    return steps.agg(
        F.max("done").alias("done"),
        F.max_by("pct", "batch").alias("pct"),
        F.count_if(F.col("pct") < F.col("_before")).alias("steps_back"),
        F.sum("n").alias("read"),
    )


# Payload jobs ----------------------------------------------------------------


@query
def int_list_items(spark, sf_dir):
    decoded = decode_int_lists(lineitem_lists(spark, sf_dir).drop("numbers"))
    return decoded.select(
        "l_orderkey", "l_linenumber", F.posexplode("numbers").alias("pos", "item")
    )


@query
def int_list_items_sql_engine(spark, sf_dir):
    decoded = decode_int_lists(lineitem_lists(spark, sf_dir).drop("numbers"), engine="sql")
    return decoded.select(
        "l_orderkey", "l_linenumber", F.posexplode("numbers").alias("pos", "item")
    )


@query
def list_sums(spark, sf_dir):
    """Decoding and summing as two steps."""
    decoded = decode_int_lists(document_lists(spark, sf_dir))
    return list_sum(decoded).select("doc_id", F.size("numbers").alias("items"), "sum")


@query
def fused_list_sums(spark, sf_dir):
    """Decoding and summing as one step."""
    summed = sum_int_lists(lineitem_lists(spark, sf_dir).drop("numbers"))
    return summed.select("l_orderkey", "l_linenumber", "sum")


def _signed_micros(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(instant("ts"))
    number = F.when(F.col("event_type") == "error", -micros).otherwise(micros)
    return encode_sums(events.select("event_id", number.alias("n")), "n")


@query
def sum_codec(spark, sf_dir):
    """Wide numbers of both signs through the sum payload."""
    return decode_sums(_signed_micros(spark, sf_dir)).select("event_id", "sum")


@query
def sum_codec_sql_engine(spark, sf_dir):
    return decode_sums(_signed_micros(spark, sf_dir), engine="sql").select("event_id", "sum")


@query
def messages(spark, sf_dir):
    decoded = decode_messages(event_messages(spark, sf_dir))
    return decoded.select("message_id", "event_time", "content")


@query
def messages_sql_engine(spark, sf_dir):
    decoded = decode_messages(event_messages(spark, sf_dir), engine="sql")
    return decoded.select("message_id", "event_time", "content")


@query
def document_contents(spark, sf_dir):
    """Whole texts as message content."""
    decoded = decode_messages(document_messages(spark, sf_dir))
    return decoded.select(
        "message_id",
        F.col("event_time").cast("bigint").alias("declared_chars"),
        F.length("content").cast("bigint").alias("chars"),
        F.md5("content").alias("digest"),
    )


@query
def typed_messages(spark, sf_dir):
    """A topic read through a record schema."""
    typed = decode_topic(event_messages(spark, sf_dir), MESSAGE_SCHEMA)
    return typed.select("note_id", "sent_at", "body")


@query
def typed_lists(spark, sf_dir):
    typed = decode_topic(lineitem_lists(spark, sf_dir).drop("numbers"), LIST_SCHEMA)
    return typed.select("l_orderkey", "l_linenumber", F.array_join("basket", ",").alias("basket"))


@query
def typed_records(spark, sf_dir):
    """A record of seven fields, two of them optional and one an array, through a topic."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    records = events.select(
        F.col("event_id").alias("id"),
        kind.alias("kind"),
        F.when(kind != "view", F.col("props")).alias("note"),
        F.col("value").alias("weight"),
        (kind == "error").alias("alert"),
        F.when(kind == "click", F.array()).otherwise(F.array("user_id", -F.col("event_id"))).alias("links"),
        F.when(kind != "signup", F.unix_micros(instant("ts"))).alias("sent"),
    )
    sent = encode_records(records, EVENT_SCHEMA).select("value")
    typed = decode_topic(sent, EVENT_SCHEMA).where("error IS NULL")
    links = F.array_join("links", ",").alias("links")
    return typed.select("id", "kind", "note", "weight", "alert", links, "sent")


@query
def typed_sums(spark, sf_dir):
    sums = jobs.stream_sum(lineitem_lists(spark, sf_dir))
    typed = decode_topic(sums, SUM_SCHEMA)
    return typed.select(from_text_key().alias("l_orderkey"), "total")


@query
def null_payloads(spark, sf_dir):
    """Error events lose their payload; such records are counted and dropped."""
    events = event_messages(spark, sf_dir)
    sent = events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    seen = count_rows(sent, by=("event_type",))
    return seen.withColumn("left", F.col("n") - F.col("null_values"))


@query
def observed_rows(spark, sf_dir):
    """The counters of a job, taken while it runs."""
    events = event_messages(spark, sf_dir)
    sent = events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    seen, figures = observe_rows(sent)
    jobs.message_monitor(seen).write.format("noop").mode("overwrite").save()
    counted = figures.get
    return spark.createDataFrame(
        [(counted["n"], counted["null_value"])], "n bigint, null_value bigint"
    )


def _cut_events(spark, sf_dir) -> DataFrame:
    """Event messages, those of sign-ups cut by one byte."""
    events = event_messages(spark, sf_dir)
    whole = F.octet_length("value")
    cut = F.substring("value", F.lit(1), whole - 1)
    return events.withColumn(
        "value", F.when(F.col("event_type") == "signup", cut).otherwise(F.col("value"))
    )


@query
def quarantine(spark, sf_dir):
    """Records that cannot be read, with origin and reason."""
    _, bad = split_quarantine(decode_messages(_cut_events(spark, sf_dir)))
    size = F.octet_length("value").alias("size")
    return bad.select("topic", "partition", "offset", "error", size)


@query
def quarantine_rest(spark, sf_dir):
    """The other side of the split."""
    good, _ = split_quarantine(decode_messages(_cut_events(spark, sf_dir)))
    return good.select("partition", "offset", "message_id", "content")


def _sparse_messages(spark, sf_dir) -> DataFrame:
    """Decoded messages that lack a field, a different one per event type."""
    decoded = decode_messages(event_messages(spark, sf_dir))

    def unless(kind: str, name: str):
        return F.when(F.col("event_type") != kind, F.col(name)).alias(name)

    return decoded.select(
        "event_id",
        unless("view", "message_id"),
        unless("click", "event_time"),
        unless("error", "content"),
        (epoch_seconds(F.col("timestamp")) + 2.0).alias("received_time"),
    )


@query
def field_defaults(spark, sf_dir):
    filled = with_defaults(_sparse_messages(spark, sf_dir), "zero")
    return filled.select("event_id", "message_id", "event_time", "content")


@query
def field_defaults_received(spark, sf_dir):
    filled = with_defaults(_sparse_messages(spark, sf_dir), "received")
    return filled.select("event_id", "message_id", "event_time", "content")


# Projections -----------------------------------------------------------------


def _delayed(spark, sf_dir) -> DataFrame:
    """Decoded event messages that arrive ``value`` milliseconds late."""
    decoded = decode_messages(event_messages(spark, sf_dir, None, "delay"))
    return with_latency(decoded, F.col("event_time") + F.col("delay") / F.lit(1000.0))


@query
def latency(spark, sf_dir):
    return _delayed(spark, sf_dir).select("event_id", "received_time", "latency")


@query
def latency_by_type(spark, sf_dir):
    micros = F.round(F.col("latency") * F.lit(1e6)).cast("bigint")
    return (
        _delayed(spark, sf_dir)
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(micros).alias("total_micros"),
            F.max("latency").alias("worst"),
        )
    )


def _whole_millis():
    return F.floor(F.unix_micros(instant("ts")) / F.lit(1000)).cast("double") / F.lit(1000.0)


@query
def report_lines(spark, sf_dir):
    decoded = decode_messages(event_messages(spark, sf_dir, _whole_millis(), "delay"))
    timed = with_latency(decoded, F.col("event_time") + F.floor("delay"))
    return format_report(timed).select("event_id", "line", "latency_line")


@query
def report_lines_rounded(spark, sf_dir):
    """The other style of the same lines, without trailing zeros."""
    decoded = decode_messages(event_messages(spark, sf_dir, _whole_millis(), "delay"))
    timed = with_latency(decoded, F.col("event_time") + F.floor("delay"))
    return format_report(timed, "rounded").select("event_id", "line", "latency_line")


# Figures ---------------------------------------------------------------------


@query
def throughput_5s(spark, sf_dir):
    rates = throughput(event_messages(spark, sf_dir))
    return rates.select(_no_zone("window_start"), "n", "per_sec", "rate")


@query
def throughput_by_worker(spark, sf_dir):
    rates = throughput_by(event_messages(spark, sf_dir), "partition", min_rows=100)
    return rates.select("partition", "n", "seconds", "per_sec")


@query
def throughput_by_worker_daily(spark, sf_dir):
    rates = throughput_by(
        event_messages(spark, sf_dir), "partition", window="1 day", min_rows=2
    )
    return rates.select("partition", _no_zone("window_start"), "n", "seconds", "per_sec")


@query
def throughput_every_100_by_gaps(spark, sf_dir):
    """The same over offsets with gaps: the events of a partition keep their ids."""
    return throughput_per_rows(event_messages(spark, sf_dir), rows=100)


@query
def throughput_every_100(spark, sf_dir):
    """A report after every hundred records of a partition."""
    return throughput_per_rows(dense_events(spark, sf_dir), rows=100)


@query
def hourly_progress(spark, sf_dir):
    done = progress(event_messages(spark, sf_dir), tick="1 hour")
    return done.select(_no_zone("tick"), "done", "pct")


@query
def one_run(spark, sf_dir):
    return run_summary(event_messages(spark, sf_dir))


@query
def row_counts(spark, sf_dir):
    return count_rows(event_messages(spark, sf_dir))


def _offset_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What consumers have committed, and where the partitions end: a group per
    event type stands behind its last own event, the group ``ahead`` past the
    end."""
    own = dense_events(spark, sf_dir).groupBy(
        F.col("event_type").alias("group"), "topic", "partition"
    )
    own = own.agg((F.max("offset") + 1).alias("committed"))
    ends = own.groupBy("topic", "partition").agg(F.max("committed").alias("end"))
    ahead = ends.select(
        F.lit("ahead").alias("group"), "topic", "partition", (F.col("end") + 100).alias("committed")
    )
    return own.unionByName(ahead), ends


@query
def lag(spark, sf_dir):
    return consumer_lag(*_offset_tables(spark, sf_dir))


@query
def lag_unknown_group(spark, sf_dir):
    """One group per nation name besides; none of them has ever read."""
    committed, ends = _offset_tables(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("group"))
    groups = committed.select("group").union(nations)
    return lag_lines(consumer_lag(committed, ends, groups))


def _lagging(spark, sf_dir, name: str) -> TopicSpec:
    """A topic of events, some without a payload, that a job has drained; then the
    clicks arrive once more."""
    source, sink = _specs(spark, name)
    events = dense_events(spark, sf_dir)
    value = F.when(F.col("event_type") != "error", F.col("value"))
    write_topic(_as_topic(events.withColumn("value", value), source), source)
    _drained(streams.start_message_monitor(spark, source, out=sink.path))
    shift = end_offsets(read_topic_batch(spark, source)).select("partition", "end")
    late = events.where("event_type = 'click'").drop("offset")
    late = with_offsets(late, "event_id").join(shift, "partition")
    late = late.withColumn("offset", F.col("offset") + F.col("end")).drop("end")
    write_topic(_as_topic(late, source), source)
    return source


@query
def lag_of_running_job(spark, sf_dir):
    """A job has drained a topic, then more arrives: its lag is what arrived. What the
    job has committed is what it read, with or without a result."""
    source = _lagging(spark, sf_dir, "lag_of_running_job")
    committed = group_offsets(spark, source, "message_monitor")
    found = consumer_lag(committed, end_offsets(read_topic_batch(spark, source)))
    return found.withColumn("group", F.lit("monitor"))


@query
def lag_monitor_look(spark, sf_dir):
    """One look of the running lag monitor, at that job and at groups that never read."""
    source = _lagging(spark, sf_dir, "lag_monitor_look")
    path, seen = scratch_path(spark, "lag_lines"), threading.Event()

    def report(lag: DataFrame) -> None:
        if not seen.is_set():
            lag.write.parquet(path)
            seen.set()

    groups = table(spark, sf_dir, "region").select(F.col("r_name").alias("group"))
    monitor = streams.start_lag_monitor(
        spark,
        committed=lambda: group_offsets(spark, source, "message_monitor"),
        ends=track_ends(spark, source),
        groups=groups.union(groups.select(F.lit(source.group))),
        report=report,
        name=f"{source.group}-look",
    )
    while not seen.wait(0.2) and monitor.isActive:
        pass
    monitor.stop()
    if not seen.is_set():
        raise monitor.exception()
    known = F.lit(source.group)
    name, line = (F.replace(c, known, F.lit("monitor")).alias(c) for c in ("group", "line"))
    return spark.read.parquet(path).select(name, "total_lag", "found", line)


# Layout and bounded reads ----------------------------------------------------


@query
def dense_offsets(spark, sf_dir):
    return dense_events(spark, sf_dir).select("partition", "offset", "event_id")


@query
def key_layout(spark, sf_dir):
    """Equal keys share a partition; a table on disk has one folder for each."""
    source, _ = _specs(spark, "key_layout", partitions=12)
    events = event_messages(spark, sf_dir).drop("partition")
    write_topic(
        _as_topic(with_partition(events, source.partitions, "key", "event_id"), source),
        source,
        spread=True,
    )
    stored = read_topic_batch(spark, source)
    keys = stored.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("partition").alias("low"),
        F.max("partition").alias("high"),
    )
    return keys.agg(
        F.sum("rows").alias("records"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("low") != F.col("high")).alias("split_keys"),
        F.count_if((F.col("low") < 0) | (F.col("high") >= source.partitions)).alias("stray_keys"),
    )


@query
def bounded_read(spark, sf_dir):
    """Named partitions between named offsets."""
    source, _ = _specs(spark, "bounded_read")
    write_topic(_as_topic(dense_events(spark, sf_dir), source), source, spread=True)
    read = read_topic_batch(
        spark, source, partitions=[0, 3, 5], start={0: 10, 3: 20}, end={3: 90, 5: 70}
    )
    return decode_messages(read).select("partition", "offset", "message_id")


@query
def first_5000(spark, sf_dir):
    """Exactly the first 5000 records by partition and offset."""
    source, _ = _specs(spark, "first_5000")
    write_topic(_as_topic(event_messages(spark, sf_dir), source), source)
    first = first_records(read_topic_batch(spark, source), 5000)
    return decode_messages(first).select("partition", "offset", "message_id")


@query
def first_5000_streaming(spark, sf_dir):
    """The same number from a continuing read that ends there by itself, and a second
    start that adds nothing. All events are in one partition here, and in one batch."""
    source, sink = _specs(spark, "first_5000_streaming")
    topic = _as_topic(event_messages(spark, sf_dir), source)
    write_topic(topic.withColumn("partition", F.lit(0)).repartition(3), source)
    for _ in range(2):
        _drained(streams.start_first_records(spark, source, sink.path, 5000))
    taken = decode_messages(spark.read.parquet(sink.path).drop("error"))
    return taken.select("partition", "offset", "message_id")


@query
def latest_start(spark, sf_dir):
    """A group that starts at the newest record skips what was there (orders)
    and misses nothing that comes later (events), not even while it is down."""
    source, sink = _specs(spark, "latest_start", start="latest")
    orders = order_messages(spark, sf_dir)
    write_topic(_as_topic(orders, source), source)
    _drained(streams.start_message_monitor(spark, source, out=sink.path))
    last = orders.agg(F.max("offset")).first()[0]
    events = event_messages(spark, sf_dir).withColumn("offset", F.col("offset") + last + 1)
    write_topic(_as_topic(events, source), source)
    _drained(streams.start_message_monitor(spark, source, out=sink.path))
    return spark.read.parquet(sink.path).select("message_id", "content")


@query
def repeated_delivery(spark, sf_dir):
    """A topic that was delivered twice, each record counted once."""
    events = event_messages(spark, sf_dir)
    decoded = decode_messages(drop_repeats(union_topics(events, events)))
    return decoded.select("partition", "offset", "message_id", "content")


@query
def interop_union(spark, sf_dir):
    """Three producers, one topic, one decoder."""
    sent = union_topics(
        *[
            topic(spark, sf_dir).select("key", "value", "topic", "partition", "offset")
            for topic in (event_messages, order_messages, document_messages)
        ]
    )
    decoded = decode_messages(sent)
    return decoded.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("error").alias("unreadable"),
        F.min("message_id").alias("first_id"),
        F.max("message_id").alias("last_id"),
        F.sum(F.length("content").cast("bigint")).alias("chars"),
    )


# Generators ------------------------------------------------------------------


def _list_figures(lists: DataFrame) -> DataFrame:
    decoded = list_sum(decode_int_lists(lists))
    return decoded.agg(
        F.count(F.lit(1)).alias("lists"),
        F.count("error").alias("unreadable"),
        F.min(F.size("numbers")).cast("bigint").alias("shortest"),
        F.max(F.size("numbers")).cast("bigint").alias("longest"),
        F.min(F.array_min("numbers")).alias("smallest_item"),
        F.max(F.array_max("numbers")).alias("largest_item"),
    )


@query
def generated_lists(spark, sf_dir):
    """A random list per order, through the payload and back."""
    made = with_random_list(table(spark, sf_dir, "orders"), "o_orderkey", seed=7)
    return _list_figures(made.select("value"))


@query
def generated_lists_streaming(spark, sf_dir):
    """The same from a stream of orders into a topic."""
    source, _ = _specs(spark, "generated_lists_streaming")
    made = with_random_list(table_stream(spark, sf_dir, "orders"), "o_orderkey", seed=7)
    rows = made.select(
        "value", partition_of("o_custkey").alias("partition"), F.col("o_orderkey").alias("offset")
    )
    _drained(write_topic_stream(rows, source, source.group, "list_feed"))
    return _list_figures(read_topic_batch(spark, source))


def _timed_orders(orders: DataFrame) -> DataFrame:
    """A message per order, one every two seconds."""
    at = F.lit(1_704_067_200.0) + F.col("o_orderkey") * 2.0
    return with_message(orders, F.col("o_orderkey"), at).select(
        "value",
        text_key("o_custkey").alias("key"),
        partition_of("o_custkey").alias("partition"),
        F.col("o_orderkey").alias("offset"),
        to_timestamp(F.col("event_time")).alias("timestamp"),
    )


def _timed_messages(stored: DataFrame) -> DataFrame:
    return decode_messages(stored).select(
        "message_id", "event_time", "content", _no_zone("timestamp")
    )


@query
def generated_messages(spark, sf_dir):
    """Timed messages into a topic and back."""
    source, _ = _specs(spark, "generated_messages")
    write_topic(_timed_orders(table(spark, sf_dir, "orders")), source)
    return _timed_messages(read_topic_batch(spark, source))


@query
def message_feed_streaming(spark, sf_dir):
    """The same as a feed: a stream of orders into a topic."""
    source, _ = _specs(spark, "message_feed_streaming")
    feed = _timed_orders(table_stream(spark, sf_dir, "orders"))
    _drained(write_topic_stream(feed, source, source.group, "message_feed"))
    return _timed_messages(read_topic_batch(spark, source))


# Monitor and result tail -----------------------------------------------------


def _monitor_columns(reports: DataFrame) -> DataFrame:
    return reports.select(
        "partition", "offset", "message_id", "event_time", "content", "latency", "error"
    )


def _received():
    """A receipt up to nine seconds after the event."""
    return F.col("event_time") + F.col("offset") % 10


@query
def message_monitor(spark, sf_dir):
    return _monitor_columns(jobs.message_monitor(_cut_events(spark, sf_dir), _received()))


@query
def message_monitor_streaming(spark, sf_dir):
    source, sink = _specs(spark, "message_monitor_streaming", max_files_per_batch=4)
    write_topic(_as_topic(_cut_events(spark, sf_dir), source), source)
    _drained(streams.start_message_monitor(spark, source, sink.path, _received()))
    return _monitor_columns(spark.read.parquet(sink.path))


@query
def result_tail(spark, sf_dir):
    sums = jobs.stream_sum(lineitem_lists(spark, sf_dir))
    tail = jobs.result_tail(sums)
    return tail.select(_no_zone("window_start"), "n", "per_sec", "rate")


@query
def result_tail_streaming(spark, sf_dir):
    source, sink = _specs(spark, "result_tail_streaming", max_files_per_batch=4)
    write_topic(_as_topic(lineitem_lists(spark, sf_dir), source).drop("offset"), source)
    jobs.process_backlog(spark, source, sink)
    results = TopicSpec(jobs.SUMS, path=sink.path, group=source.group, start="earliest")
    _drained(streams.start_result_tail(spark, results, out=f"{sink.path}-tail"))
    tail = streams.latest_windows(spark, f"{sink.path}-tail")
    return tail.select(_no_zone("window_start"), "n", "per_sec", "rate")


assert PARTITIONS == 8  # the oracles name the partition of a key
