"""Records of any flat shape: against one value at a time, and broken in every place."""

from __future__ import annotations

import random
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import wire

from tallyline.functions import payload_arrow
from tallyline.operators.payloads import decode_topic, encode_records
from tallyline.sources import schemas

ROOT = Path(__file__).resolve().parents[1]
SYMBOLS = ["red", "green", "blue"]
SCHEMA = {
    "type": "record",
    "name": "Everything",
    "fields": [
        {"name": "id", "type": "long"},
        {"name": "small", "type": "int"},
        {"name": "on", "type": "boolean"},
        {"name": "half", "type": "float"},
        {"name": "whole", "type": {"type": "double"}},
        {"name": "name", "type": ["null", "string"]},
        {"name": "blob", "type": "bytes"},
        {"name": "tag", "type": {"type": "fixed", "name": "Tag", "size": 3}},
        {"name": "colour", "type": {"type": "enum", "name": "C", "symbols": SYMBOLS}},
        {"name": "links", "type": {"type": "array", "items": "long"}},
        {"name": "words", "type": [{"type": "array", "items": "string"}, "null"]},
        {"name": "grid", "type": {"type": "array", "items": {"type": "array", "items": "double"}}},
        {"name": "last", "type": ["boolean", "null"]},
    ],
}
NAMES = [f["name"] for f in SCHEMA["fields"]]


def put_text(text) -> bytes:
    raw = text.encode() if isinstance(text, str) else text
    return wire.put(len(raw)) + raw


def put_array(items, put, blocks=None) -> bytes:
    sizes = blocks if blocks is not None else ([len(items)] if items else [])
    out, rest = b"", list(items)
    for size in sizes:
        body = b"".join(put(i) for i in rest[: abs(size)])
        rest = rest[abs(size) :]
        out += wire.put(size) + (wire.put(len(body)) if size < 0 else b"") + body
    return out + b"\x00"


def put_record(r, split=None) -> bytes:
    """One field after the other; ``split`` cuts arrays into blocks."""
    cut = (lambda n: split(n)) if split else (lambda n: None)
    double = lambda x: struct.pack("<d", x)
    out = wire.put(r["id"]) + wire.put(r["small"]) + bytes([r["on"]])
    out += struct.pack("<f", r["half"]) + double(r["whole"])
    out += wire.put(0) if r["name"] is None else wire.put(1) + put_text(r["name"])
    out += put_text(r["blob"]) + r["tag"] + wire.put(SYMBOLS.index(r["colour"]))
    out += put_array(r["links"], wire.put, cut(len(r["links"])))
    if r["words"] is None:
        out += wire.put(1)
    else:
        out += wire.put(0) + put_array(r["words"], put_text, cut(len(r["words"])))
    out += put_array(r["grid"], lambda g: put_array(g, double))
    return out + (wire.put(1) if r["last"] is None else wire.put(0) + bytes([r["last"]]))


def records(n, seed=1):
    dice = random.Random(seed)
    wide = lambda: dice.choice([0, -1, 63, -65, 2**62, -(2**63), dice.randrange(10**6)])
    text = lambda: "".join(dice.choice("aé漢\U0001f600 ") for _ in range(dice.randrange(5)))
    return [
        {
            "id": wide(), "small": dice.randrange(-(2**31), 2**31), "on": dice.random() < 0.5,
            "half": dice.choice([0.5, -2.25, 0.0]), "whole": dice.random() * 1e6,
            "name": dice.choice([None, text()]), "blob": bytes(dice.randrange(256) for _ in range(dice.randrange(4))),
            "tag": bytes(dice.randrange(256) for _ in range(3)), "colour": dice.choice(SYMBOLS),
            "links": [wide() for _ in range(dice.randrange(6))],
            "words": dice.choice([None, [text() for _ in range(dice.randrange(4))]]),
            "grid": [[dice.random()] * dice.randrange(3) for _ in range(dice.randrange(3))],
            "last": dice.choice([None, True, False]),
        }
        for _ in range(n)
    ]


def kinds():
    return [kind for _, kind in schemas.record_fields(SCHEMA)]


def decode(payloads):
    found = payload_arrow.record(kinds()).func(pa.array(payloads, pa.binary())).to_pylist()
    return [({n: r[f"f{i}"] for i, n in enumerate(NAMES)}, r["error"]) for r in found]


def test_equal_to_one_value_at_a_time():
    rows = records(500)
    assert decode([put_record(r) for r in rows]) == [(r, None) for r in rows]


def test_arrays_in_blocks():
    dice = random.Random(3)

    def split(n):
        sizes = []
        while n:
            size = dice.randint(1, n)
            sizes.append(size if dice.random() < 0.5 else -size)
            n -= size
        return sizes

    rows = records(300, seed=2)
    assert decode([put_record(r, split) for r in rows]) == [(r, None) for r in rows]


def test_encoder_writes_the_same_bytes(spark):
    rows = records(200, seed=4)
    fields = schemas.record_fields(SCHEMA)
    columns = [
        pa.array([r[n] for r in rows], payload_arrow._arrow_type(kind)) for n, kind in fields
    ]
    made = payload_arrow.record_bytes(kinds()).func(*columns)
    assert made.to_pylist() == [put_record(r) for r in rows]


def test_every_cut_is_truncated():
    row = records(40, seed=5)[7]
    whole = put_record(row)
    found = decode([whole[:i] for i in range(len(whole))] + [whole, whole + b"\x55", None])
    blank = dict.fromkeys(NAMES)
    assert found[: len(whole)] == [(blank, "truncated")] * len(whole)
    assert found[len(whole) :] == [(row, None), (row, None), (blank, None)]


def test_random_bytes_have_a_reason_or_a_record():
    dice = random.Random(6)
    rows = records(300, seed=7)
    payloads = []
    for r in rows:
        raw = bytearray(put_record(r))
        raw[dice.randrange(len(raw))] = dice.randrange(256)
        payloads.append(bytes(raw))
    for (record, error), payload in zip(decode(payloads), payloads, strict=True):
        if error is None:
            assert record["id"] is not None and len(record["tag"]) == 3
        else:
            assert error in payload_arrow.REASONS and set(record.values()) == {None}


@pytest.mark.parametrize(
    "kind, payload, reason",
    [
        ("boolean", b"\x02", "invalid_boolean"), ((0, "long"), b"\x04\x00", "invalid_choice"),
        (("enum", ("a", "b")), b"\x04", "invalid_choice"), (("enum", ("a",)), b"\x01", "invalid_choice"),
        ("string", b"\x04\xff\xff", "invalid_utf8"), ("bytes", b"\x01", "negative_length"),
        (("array", "string"), b"\x02\x04\xff\xff\x00", "invalid_utf8"),
        (("array", "long"), b"\x02" + b"\x80" * 11 + b"\x00", "varint_too_long"),
        (("array", "double"), b"\xfe\xff\xff\xff\x0f" + b"\x00" * 24, "truncated"),
    ],
)
def test_reasons(kind, payload, reason):
    found = payload_arrow.record([kind]).func(pa.array([payload, payload], pa.binary()))
    assert found.to_pylist() == [{"f0": None, "error": reason}] * 2


def test_topic_by_schema(spark):
    rows = records(60, seed=8)
    df = spark.createDataFrame([(bytearray(put_record(r)), i, "x") for i, r in enumerate(rows)], "value binary, offset long, name string")
    typed = decode_topic(df, SCHEMA).orderBy("offset")
    assert typed.columns == ["value", "offset", *NAMES, "error"]
    for found, row in zip(typed.collect(), rows, strict=True):
        assert {n: found[n] for n in NAMES} == row and found["error"] is None
    again = encode_records(typed.drop("value"), SCHEMA).orderBy("offset").collect()
    assert [bytes(r["value"]) for r in again] == [put_record(r) for r in rows]
    with pytest.raises(ValueError, match="arrow"):
        decode_topic(df, SCHEMA, engine="sql")


def test_what_a_field_cannot_hold_makes_no_payload(spark):
    schema = {"type": "record", "name": "R", "fields": [
        {"name": "a", "type": {"type": "array", "items": "long"}},
        {"name": "t", "type": ["null", {"type": "fixed", "name": "T", "size": 2}]},
        {"name": "c", "type": {"type": "enum", "name": "E", "symbols": SYMBOLS}},
    ]}
    rows = [
        ([1], b"ab", "red"), ([1, None], b"ab", "red"), (None, b"ab", "red"), ([], None, "blue"),
        ([], b"abc", "red"), ([], b"ab", "pink"), ([], b"ab", None),
    ]
    df = spark.createDataFrame(rows, "a array<bigint>, t binary, c string").coalesce(1)
    made = [r["value"] for r in encode_records(df, schema).collect()]
    assert [v is not None for v in made] == [True, False, False, True, False, False, False]
    assert bytes(made[3]) == b"\x00\x00\x04"


# A single payload of any length -------------------------------------------------------


def long_payload(blocks, size, dice):
    numbers = [[int(x) for x in dice.integers(-(2**40), 2**40, size)] for _ in range(blocks)]
    signs = [size if i % 2 else -size for i in range(blocks)]
    return wire.put_list(sum(numbers, []), signs), sum(map(sum, numbers))


@pytest.mark.parametrize("piece", [16, 61, 1000])
def test_long_payloads_by_pieces(monkeypatch, piece):
    monkeypatch.setattr(payload_arrow, "PIECE", piece)
    dice = np.random.default_rng(piece)
    for blocks, size in ((1, 300), (40, 9), (300, 1)):
        payload, total = long_payload(blocks, size, dice)
        assert payload_arrow._sum_long(np.frombuffer(payload, np.uint8)) == (total, -1)
        for cut in (1, 2, 5, 17, len(payload) // 2):
            broken = np.frombuffer(payload[:-cut], np.uint8)
            assert payload_arrow._sum_long(broken) == (0, payload_arrow._TRUNCATED)
        assert payload_arrow._sum_long(np.frombuffer(payload + b"\x80" * 20, np.uint8))[0] == total
    long = payload[: len(payload) // 2]
    at = len(long) - next(i for i, b in enumerate(reversed(long)) if b < 128)
    broken = long[:at] + b"\x80" * 30 + payload[at:]
    assert payload_arrow._sum_long(np.frombuffer(broken, np.uint8)) == (0, payload_arrow._TOO_LONG)
    wide = wire.put_list([2**62] * 40)
    assert payload_arrow._sum_long(np.frombuffer(wide, np.uint8))[1] == payload_arrow._OVERFLOW


def test_long_and_short_payloads_together(monkeypatch):
    monkeypatch.setattr(payload_arrow, "PIECE", 64)
    rows = [[1, 2], list(range(500)), [], [-5], list(range(-300, 0))]
    column = pa.array([wire.put_list(r) for r in rows] + [None, b""], pa.binary())
    found = payload_arrow.int_list_sum.func(column).to_pylist()
    assert [r["sum"] for r in found] == [sum(r) for r in rows] + [None, None]
    assert [r["error"] for r in found] == [None] * 6 + ["truncated"]


_MEMORY = """
import resource
import numpy as np, pyarrow as pa
from tallyline.functions import payload_arrow as A

items = 1 << 28
head = A._varint_bytes(np.array([items]))[0].tobytes()
column = pa.array([head + b"\\x02" * items + b"\\x00"], pa.binary())
A.int_list_sum.func(column.slice(0, 0))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = A.int_list_sum.func(column).to_pylist()
assert found == [{"sum": items, "error": None}], found
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before >> 10)
"""


def test_memory_of_one_list_of_256_mib():
    run = subprocess.run(
        [sys.executable, "-c", _MEMORY], cwd=ROOT, capture_output=True, text=True, check=True
    )
    assert int(run.stdout) < 512
