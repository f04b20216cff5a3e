"""Where a topic lives and how it is read and written."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

# Names and defaults of the environment settings, and the client
# settings that go with each delivery mode.
ENV_SERVERS = "KAFKA_BOOTSTRAP_SERVERS"
ENV_MESSAGE_TOPIC = "TOPIC_NAME"
ENV_MESSAGE_GROUP = "CONSUMER_GROUP_ID"
ENV_START = "AUTO_OFFSET_RESET"
ENV_LIST_TOPIC = "INPUT_TOPIC"
ENV_SUM_TOPIC = "OUTPUT_TOPIC"
ENV_SUM_GROUP = "APPLICATION_ID"
ENV_DURABLE = "DURABLE"
DEFAULT_SERVERS = "127.0.0.1:9094"
DEFAULT_START = "latest"
DEFAULT_MESSAGE_TOPIC = "my-topic-1"
DEFAULT_MESSAGE_GROUP = "my-group-1"
DEFAULT_LIST_TOPIC = "integer-list-input-avro"
DEFAULT_SUM_TOPIC = "integer-sum-output-avro"
DEFAULT_PARTITIONS = 12
FETCH_MIN_BYTES = 1_000_000
FIRST, LAST = -2, -1  # a partition's first record, and the end of its last
DELIVERY = {
    "best_effort": {
        "kafka.acks": "0",
        "kafka.enable.idempotence": "false",
        "kafka.linger.ms": "5",
        "kafka.batch.size": "65536",
    },
    "leader": {
        "kafka.acks": "1",
        "kafka.enable.idempotence": "false",
        "kafka.linger.ms": "20",
        "kafka.batch.size": "131072",
        "kafka.compression.type": "snappy",
    },
    "durable": {
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        "kafka.linger.ms": "5",
        "kafka.batch.size": "65536",
    },
}

Offsets = Mapping[int, int]


@dataclass(frozen=True)
class TopicSpec:
    """A topic in table form (``path``) or at a broker (``servers``).

    ``path`` is the root of a Parquet table laid out by topic and partition. A
    root has one kind of writer: streaming jobs keep a commit log in it that
    hides files written any other way.
    """

    topic: str
    path: str | None = None
    servers: str | None = None
    group: str = "default"
    start: str | Offsets = DEFAULT_START
    delivery: str = "leader"
    partitions: int = DEFAULT_PARTITIONS
    max_rows_per_batch: int | None = None
    max_files_per_batch: int | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if (self.path is None) == (self.servers is None):
            raise ValueError("give either a table path or broker servers")
        if self.delivery not in DELIVERY:
            raise ValueError(f"delivery must be one of {sorted(DELIVERY)}")
        if isinstance(self.start, str) and self.start not in ("earliest", "latest"):
            raise ValueError("start must be 'earliest', 'latest' or offsets by partition")
        if self.partitions < 1:
            raise ValueError("a topic has at least one partition")
        if self.is_table and self.max_rows_per_batch:
            raise ValueError("batches of a table are limited by files, not by rows")
        if not self.is_table and self.max_files_per_batch:
            raise ValueError("batches of a broker topic are limited by rows, not by files")

    @property
    def is_table(self) -> bool:
        return self.path is not None


def offsets_json(topic: str, offsets: Offsets) -> str:
    return json.dumps({topic: {str(p): int(o) for p, o in sorted(offsets.items())}})


def _for_all(spec: TopicSpec, partitions: Iterable[int], given: Offsets, rest: int) -> str:
    """Offsets for every partition that is read, as Spark asks for. As in the table
    form, a partition that has none of its own is read whole."""
    named = sorted(set(partitions) | set(given))
    return offsets_json(spec.topic, {p: given.get(p, rest) for p in named})


def stream_read_options(spec: TopicSpec) -> dict[str, str]:
    """Options of a continuing subscription at a broker; a start given by offsets
    covers all of ``spec.partitions``."""
    start = spec.start
    if not isinstance(start, str):
        start = _for_all(spec, range(spec.partitions), start, FIRST)
    options = {
        "kafka.bootstrap.servers": spec.servers,
        "subscribe": spec.topic,
        "startingOffsets": start,
        "groupIdPrefix": spec.group,
        "kafka.fetch.min.bytes": str(FETCH_MIN_BYTES),
    }
    if spec.max_rows_per_batch:
        options["maxOffsetsPerTrigger"] = str(spec.max_rows_per_batch)
    return {**options, **spec.options}


def batch_read_options(
    spec: TopicSpec,
    partitions: list[int] | None = None,
    start: Offsets | None = None,
    end: Offsets | None = None,
) -> dict[str, str]:
    """Options of a bounded read at a broker. Partitions without an offset of
    their own are read from the first to the last record."""
    options = {"kafka.bootstrap.servers": spec.servers}
    if partitions is None:
        options["subscribe"] = spec.topic
        read = set(range(spec.partitions))
    else:
        read = set(partitions)
        options["assign"] = json.dumps({spec.topic: sorted(read)})
        start, end = (
            {p: o for p, o in (given or {}).items() if p in read} for given in (start, end)
        )
    options["startingOffsets"] = _for_all(spec, read, start, FIRST) if start else "earliest"
    options["endingOffsets"] = _for_all(spec, read, end, LAST) if end else "latest"
    return {**options, **spec.options}


def write_options(spec: TopicSpec) -> dict[str, str]:
    """Options of a broker sink. Spark's sink delivers at least once in every
    mode; readers that must not see a record twice drop duplicates."""
    return {"kafka.bootstrap.servers": spec.servers, **DELIVERY[spec.delivery], **spec.options}


def _servers(env: Mapping[str, str]) -> str:
    return env.get(ENV_SERVERS, DEFAULT_SERVERS)


def message_topic_from_env(env: Mapping[str, str]) -> TopicSpec:
    return TopicSpec(
        topic=env.get(ENV_MESSAGE_TOPIC, DEFAULT_MESSAGE_TOPIC),
        servers=_servers(env),
        group=env.get(ENV_MESSAGE_GROUP, DEFAULT_MESSAGE_GROUP),
        start=env.get(ENV_START, DEFAULT_START),
        delivery="durable",
    )


def sum_topics_from_env(env: Mapping[str, str]) -> tuple[TopicSpec, TopicSpec]:
    """Input and output topic of the list sum job."""
    delivery = "durable" if ENV_DURABLE in env else "leader"
    source = TopicSpec(
        topic=env.get(ENV_LIST_TOPIC, DEFAULT_LIST_TOPIC),
        servers=_servers(env),
        group=env.get(ENV_SUM_GROUP, "stream-sum"),
        start="earliest",
    )
    sink = TopicSpec(
        topic=env.get(ENV_SUM_TOPIC, DEFAULT_SUM_TOPIC), servers=_servers(env), delivery=delivery
    )
    return source, sink
