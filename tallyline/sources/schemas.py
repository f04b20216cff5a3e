"""Row layouts of topics and of the three record kinds."""

from __future__ import annotations

import json

from pyspark.sql import types as T

TOPIC = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)

# A topic table on disk also says why a set-aside row could not be decoded.
STORED_TOPIC = T.StructType([*TOPIC.fields, T.StructField("error", T.StringType())])

INT_LIST, SUM, MESSAGE, ANY = "int_list", "sum", "message", "any"

# Records with decoders of their own.
_SHAPES = {
    (("array", "int"),): INT_LIST,
    (("array", "long"),): INT_LIST,
    ("long",): SUM,
    ("long", "double", "string"): MESSAGE,
}
_NAMES = ("boolean", "int", "long", "float", "double", "bytes", "string")


def _kind(declared, inside: bool = False):
    """What ``functions.payload_arrow.record`` calls the type of a field."""
    if isinstance(declared, list):
        rest = [part for part in declared if part != "null"]
        if inside or len(declared) != 2 or len(rest) != 1:
            raise ValueError(f"no column type for {declared!r}: a choice is of null and one type")
        return declared.index("null"), _kind(rest[0], True)
    if isinstance(declared, dict):
        name = declared.get("type")
        if name == "array":
            return "array", _kind(declared["items"], True)
        if name == "fixed":
            return "fixed", int(declared["size"])
        if name == "enum":
            return "enum", tuple(declared["symbols"])
        return _kind(name, inside)
    if declared not in _NAMES:
        raise ValueError(f"no column type for {declared!r}")
    return declared


def record_fields(avsc: str | dict) -> list[tuple[str, object]]:
    """Name and kind of every field of a record schema given as JSON. Records are flat:
    fields are numbers, texts, bytes, booleans, choices by name, arrays of these, or any
    of them that may be absent."""
    record = json.loads(avsc) if isinstance(avsc, str) else avsc
    if not isinstance(record, dict) or record.get("type") != "record":
        raise ValueError("the schema must describe a record")
    fields = [(f["name"], _kind(f["type"])) for f in record["fields"]]
    if not fields:
        raise ValueError("a record has at least one field")
    if any(name == "error" for name, _ in fields):
        raise ValueError("a field cannot be called error, the column for faults")
    return fields


def record_kind(avsc: str | dict) -> str:
    """Which of the payload layouts with their own decoder a record schema describes,
    or ``ANY``."""
    return _SHAPES.get(tuple(kind for _, kind in record_fields(avsc)), ANY)
