"""Payload jobs: golden vectors, random payloads, and both engines against a
byte-by-byte reader."""

from __future__ import annotations

import math
import random
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import wire
from pyspark.sql import functions as F

from tallyline.functions import payload_arrow
from tallyline.operators import payloads as P

ROOT = Path(__file__).resolve().parents[1]

ENGINES = ["arrow", "sql"]
INT64 = (-(2**63), 2**63 - 1)

NUMBERS = [
    (0, "00"),
    (1, "02"),
    (100, "c801"),
    (127, "fe01"),
    (128, "8002"),
    (300, "d804"),
    (9223372036854775807, "feffffffffffffffff01"),
    (-1, "01"),
    (-64, "7f"),
    (-1000, "cf0f"),
    (-9223372036854775808, "ffffffffffffffffff01"),
    (63, "7e"),
    (64, "8001"),
    (-65, "8101"),
    (4611686018427387904, "80808080808080808001"),
]
LISTS = [
    ("0614283c00", [10, 20, 30], 60, "78"),
    ("00", [], 0, "00"),
    ("048001c60100", [64, 99], 163, "c602"),
    ("040204020600", [1, 2, 3], 6, "0c"),
    ("030402040306d8040900", [1, 2, 300, -5], 298, "d404"),
    ("04feffffff0fffffffff0f00", [2147483647, -2147483648], -1, "01"),
    ("020e0055", [7], 7, "0e"),
]
BROKEN_LISTS = [
    ("", "truncated"),
    ("040204", "truncated"),
    ("061428", "truncated"),
    ("0280", "truncated"),
    ("02" + "80" * 11 + "00", "varint_too_long"),
    ("02" + "80" * 10, "varint_too_long"),
    ("02" + "80" * 9, "truncated"),
    ("01", "truncated"),
    ("0102", "truncated"),
    ("ffffffffffffffffff01", "truncated"),
    ("feffffffffffffffff010200", "truncated"),
]
MESSAGES = [
    (0, 1704067207.179575, "Message 0", "00287ecb218064d941124d6573736167652030"),
    (300, 1707744000.123, "Message 300", "d8043bdf07c08672d941164d65737361676520333030"),
]


def payload_frame(spark, payloads, slices=3):
    rows = [(i, None if p is None else bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "i bigint, value binary").repartition(slices)


def by_row(df):
    return [row for row in sorted(df.collect(), key=lambda row: row["i"])]


@pytest.mark.parametrize("engine", ENGINES)
def test_numbers(spark, engine):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NUMBERS)], "i bigint, n bigint")
    encoded = P.encode_sums(df, "n", engine=engine)
    assert [bytes(r["value"]).hex() for r in by_row(encoded)] == [h for _, h in NUMBERS]
    decoded = by_row(P.decode_sums(encoded, engine=engine))
    assert [(r["sum"], r["error"]) for r in decoded] == [(n, None) for n, _ in NUMBERS]


@pytest.mark.parametrize("engine", ENGINES)
def test_sum_faults(spark, engine):
    cases = [("", "truncated"), ("80", "truncated"), ("80" * 9, "truncated")]
    cases += [("80" * 10, "varint_too_long"), ("80" * 12 + "01", "varint_too_long")]
    df = payload_frame(spark, [bytes.fromhex(h) for h, _ in cases] + [b"\x02\xff", None])
    found = [(r["sum"], r["error"]) for r in by_row(P.decode_sums(df, engine=engine))]
    assert found == [(None, why) for _, why in cases] + [(1, None), (None, None)]


@pytest.mark.parametrize("engine", ENGINES)
def test_lists(spark, engine):
    df = payload_frame(spark, [bytes.fromhex(h) for h, *_ in LISTS])
    rows = by_row(P.decode_int_lists(df, engine=engine))
    assert [(r["numbers"], r["error"]) for r in rows] == [(n, None) for _, n, *_ in LISTS]
    sums = by_row(P.sum_int_lists(df, engine=engine))
    assert [(r["sum"], r["error"]) for r in sums] == [(s, None) for _, _, s, _ in LISTS]
    again = by_row(P.resum_int_lists(df, engine=engine))
    assert [bytes(r["value"]).hex() for r in again] == [h for *_, h in LISTS]


@pytest.mark.parametrize("engine", ENGINES)
def test_broken_lists(spark, engine):
    payloads = [bytes.fromhex(h) for h, _ in BROKEN_LISTS]
    df = payload_frame(spark, [*payloads, None])
    reasons = [why for _, why in BROKEN_LISTS] + [None]
    for decode, out in ((P.decode_int_lists, "numbers"), (P.sum_int_lists, "sum")):
        rows = by_row(decode(df, engine=engine))
        assert [(r[out], r["error"]) for r in rows] == [(None, why) for why in reasons]
    kept = by_row(P.resum_int_lists(df, engine=engine))
    assert [r["value"] and bytes(r["value"]) for r in kept] == [*payloads, None]


@pytest.mark.parametrize("engine", ENGINES)
def test_sum_that_does_not_fit(spark, engine):
    lists = [[INT64[1], 1], [INT64[0], -1], [INT64[1], 1, -1], [INT64[1]], [INT64[1]] * 3]
    df = payload_frame(spark, [wire.put_list(n) for n in lists])
    rows = by_row(P.sum_int_lists(df, engine=engine))
    assert [r["sum"] for r in rows][3] == INT64[1]
    assert [r["error"] for r in rows][:2] == ["sum_overflow"] * 2
    assert rows[4]["error"] == "sum_overflow"


def test_list_sum_keeps_earlier_reasons(spark):
    df = payload_frame(spark, [b"\x80", wire.put_list([INT64[1], 5]), wire.put_list([4, 5])])
    rows = by_row(P.list_sum(P.decode_int_lists(df)))
    assert [(r["sum"], r["error"]) for r in rows] == [
        (None, "truncated"),
        (None, "sum_overflow"),
        (9, None),
    ]


def random_lists(seed, how_many, low, high, longest=50):
    dice = random.Random(seed)
    lists = []
    for _ in range(how_many):
        length = dice.randint(0, longest)
        bits = [dice.randint(1, 64) for _ in range(length)]
        lists.append([max(low, min(high, dice.getrandbits(b) - 2 ** (b - 1))) for b in bits])
    return lists


@pytest.mark.parametrize("engine", ENGINES)
def test_round_trip(spark, engine):
    lists = random_lists(1, 600, *INT64) + [[INT64[0], INT64[1]], []]
    df = spark.createDataFrame(list(enumerate(lists)), "i bigint, numbers array<bigint>")
    encoded = P.encode_int_lists(df, engine=engine).cache()
    assert [bytes(r["value"]) for r in by_row(encoded)] == [wire.put_list(n) for n in lists]
    back = P.decode_int_lists(encoded.drop("numbers"), engine=engine)
    assert [(r["numbers"], r["error"]) for r in by_row(back)] == [(n, None) for n in lists]


@pytest.mark.parametrize("engine", ENGINES)
def test_random_blocks(spark, engine):
    dice = random.Random(2)
    lists = random_lists(3, 500, -(2**31), 2**31 - 1)
    payloads = []
    for numbers in lists:
        blocks, left = [], len(numbers)
        while left:
            size = dice.randint(1, left)
            blocks.append(dice.choice([size, -size]))
            left -= size
        payloads.append(wire.put_list(numbers, blocks))
    df = payload_frame(spark, payloads)
    rows = by_row(P.decode_int_lists(df, engine=engine))
    assert [(r["numbers"], r["error"]) for r in rows] == [(n, None) for n in lists]
    sums = by_row(P.sum_int_lists(df, engine=engine))
    assert [(r["sum"], r["error"]) for r in sums] == [(sum(n), None) for n in lists]


def test_a_payload_of_very_many_blocks(spark):
    numbers = [i % 7 for i in range(200_000)]
    payloads = [wire.put_list(numbers, [1, -2] * 66_666 + [2]), wire.put_list(numbers)]
    payloads += [payloads[0][:-1], wire.put_list([5], [-1])]
    row = [(sum(numbers), None)] * 2 + [(None, "truncated"), (5, None)]
    found = by_row(P.sum_int_lists(payload_frame(spark, payloads, slices=1)))
    assert [(r["sum"], r["error"]) for r in found] == row


def damaged_payloads(seed, how_many):
    """Valid payloads, cut, with bytes changed, and plain noise."""
    dice = random.Random(seed)
    out = []
    for numbers in random_lists(seed, how_many, -(2**40), 2**40, longest=12):
        payload = bytearray(wire.put_list(numbers))
        kind = dice.randrange(4)
        if kind == 1:
            payload = payload[: dice.randint(0, len(payload))]
        elif kind == 2:
            for _ in range(dice.randint(1, 3)):
                payload[dice.randrange(len(payload))] = dice.choice([0, 1, 2, 127, 128, 255])
        elif kind == 3:
            noise = [0, 1, 2, 3, 4, 128, 200]
            payload = bytes(dice.choice(noise) for _ in range(dice.randint(0, 30)))
        out.append(bytes(payload))
    return out


@pytest.mark.parametrize("engine", ENGINES)
def test_damaged_lists(spark, engine):
    payloads = damaged_payloads(5, 2000)
    expected = [wire.list_or_reason(p) for p in payloads]
    assert {why for _, why in expected} == {None, "truncated", "varint_too_long"}
    df = payload_frame(spark, payloads)
    rows = by_row(P.decode_int_lists(df, engine=engine))
    assert [(r["numbers"], r["error"]) for r in rows] == expected
    sums = by_row(P.sum_int_lists(df, engine=engine))
    for row, (numbers, why) in zip(sums, expected, strict=True):
        if numbers is None:
            assert (row["sum"], row["error"]) == (None, why)
        elif INT64[0] <= sum(numbers) <= INT64[1] and max(map(abs, numbers), default=0) < 2**60:
            assert (row["sum"], row["error"]) == (sum(numbers), None)


@pytest.mark.parametrize("engine", ENGINES)
def test_null_items_and_null_lists(spark, engine):
    df = spark.createDataFrame(
        [(0, [1, None, 3]), (1, None), (2, []), (3, [5])], "i bigint, numbers array<bigint>"
    )
    rows = by_row(P.encode_int_lists(df.coalesce(1), engine=engine))
    assert [r["value"] and bytes(r["value"]) for r in rows] == [
        None,
        None,
        wire.put_list([]),
        wire.put_list([5]),
    ]


@pytest.mark.parametrize("engine", ENGINES)
def test_messages(spark, engine):
    df = spark.createDataFrame(
        [(i, *m[:3]) for i, m in enumerate(MESSAGES)],
        "i bigint, message_id bigint, event_time double, content string",
    )
    encoded = P.encode_messages(df)
    assert [bytes(r["value"]).hex() for r in by_row(encoded)] == [m[3] for m in MESSAGES]
    rows = by_row(P.decode_messages(encoded, engine=engine))
    assert [
        (r["message_id"], r["event_time"], r["content"], r["error"]) for r in rows
    ] == [(*m[:3], None) for m in MESSAGES]


TIMES = [0.0, -0.0, 1.5, -2.25, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf]
TIMES += [-math.inf, math.nan, 1704067207.179575]
TEXTS = ["", "Message 7", "grüße", "日本語", "🚀 lost and found", "x" * 3000, "\x00\x7f"]


@pytest.mark.parametrize("engine", ENGINES)
def test_message_round_trip(spark, engine):
    dice = random.Random(8)
    messages = [
        (dice.getrandbits(dice.randint(1, 64)) - 2**63, t, text) for t in TIMES for text in TEXTS
    ]
    messages = [(max(m, INT64[0]), t, text) for m, t, text in messages]
    for _ in range(300):
        (t,) = struct.unpack("<d", dice.randbytes(8))
        messages.append((dice.randint(*INT64), t, dice.choice(TEXTS)))
    df = spark.createDataFrame(
        [(i, *m) for i, m in enumerate(messages)],
        "i bigint, message_id bigint, event_time double, content string",
    )
    encoded = P.encode_messages(df)
    rows = by_row(encoded)
    for row, (message_id, t, text) in zip(rows, messages, strict=True):
        if not math.isnan(t):
            assert bytes(row["value"]) == wire.put_message(message_id, t, text)
    for row, m in zip(by_row(P.decode_messages(encoded, engine=engine)), messages, strict=True):
        assert (row["message_id"], row["content"], row["error"]) == (m[0], m[2], None)
        assert repr(row["event_time"]) == repr(m[1])


@pytest.mark.parametrize("engine", ENGINES)
def test_damaged_messages(spark, engine):
    dice = random.Random(9)
    payloads = [bytes.fromhex(m[3])[:-1] for m in MESSAGES]
    whole = [wire.put_message(dice.randint(-300, 300), dice.random(), t) for t in TEXTS * 40]
    for payload in whole:
        cut = bytearray(payload[: dice.randint(0, len(payload))])
        payloads.append(bytes(cut))
        changed = bytearray(payload)
        changed[dice.randrange(len(changed))] = dice.choice([0, 1, 127, 128, 195, 255])
        payloads.append(bytes(changed))
    payloads += [b"\x80" * 10, b"\x80" * 9, wire.put(1) + b"\0" * 8 + b"\x80" * 11]
    payloads += [wire.put(1) + b"\0" * 8 + wire.put(-1), wire.put(1) + b"\0" * 8 + wire.put(2**62)]
    expected = [wire.message_or_reason(p) for p in payloads]
    reasons = {"truncated", "varint_too_long", "negative_length", "invalid_utf8", None}
    assert {why for _, why in expected} == reasons
    rows = by_row(P.decode_messages(payload_frame(spark, [*payloads, None]), engine=engine))
    for row, (message, why) in zip(rows, [*expected, (None, None)], strict=True):
        fields = (row["message_id"], row["event_time"], row["content"])
        assert row["error"] == why
        assert repr(fields) == repr(message or (None, None, None))


def test_missing_message_fields_make_no_payload(spark):
    df = spark.createDataFrame(
        [(0, None, 1.0, "a"), (1, 1, None, "a"), (2, 1, 1.0, None), (3, 1, 1.0, "a")],
        "i bigint, message_id bigint, event_time double, content string",
    )
    values = [r["value"] for r in by_row(P.encode_messages(df.coalesce(1)))]
    assert values[:3] == [None] * 3
    assert bytes(values[3]) == wire.put_message(1, 1.0, "a")


def test_batches_and_slices_do_not_matter(spark):
    """Small Arrow batches, empty partitions and many nulls."""
    payloads = [None if i % 3 == 0 else p for i, p in enumerate(damaged_payloads(11, 700))]
    expected = [(None, None) if p is None else wire.list_or_reason(p) for p in payloads]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = by_row(P.decode_int_lists(payload_frame(spark, payloads, slices=9)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["numbers"], r["error"]) for r in rows] == expected


def test_other_columns_pass_through(spark):
    df = payload_frame(spark, [b"\x02\x04\x00", b"\x80"]).withColumn("key", F.lit(b"k"))
    assert P.decode_int_lists(df).columns == ["i", "value", "key", "numbers", "error"]
    assert [bytes(r["key"]) for r in by_row(P.sum_int_lists(df))] == [b"k", b"k"]


def test_quarantine_split(spark):
    rows = [("t", 0, 5, bytearray(b"\x02\x04\x00")), ("t", 1, 6, bytearray(b"\x80"))]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, value binary")
    good, bad = P.split_quarantine(P.sum_int_lists(df))
    assert [(r["offset"], r["sum"]) for r in good.collect()] == [(5, 2)]
    assert good.columns == ["topic", "partition", "offset", "value", "sum"]
    assert [tuple(r) for r in bad.collect()] == [("t", 1, 6, bytearray(b"\x80"), "truncated")]


def test_unknown_engine(spark):
    with pytest.raises(ValueError, match="engine"):
        P.decode_sums(payload_frame(spark, [b""]), engine="c")


@pytest.mark.parametrize("engine", ENGINES)
def test_numbers_beyond_64_bits(spark, engine):
    """Ten bytes can hold 70 bits; what does not fit is no number."""
    most, over = b"\xff" * 9 + b"\x01", b"\xff" * 9 + b"\x02"
    sums = by_row(P.decode_sums(payload_frame(spark, [most, over]), engine=engine))
    assert [(r["sum"], r["error"]) for r in sums] == [(-(2**63), None), (None, "varint_too_long")]
    lists = payload_frame(spark, [b"\x02" + most + b"\x00", b"\x02" + over + b"\x00"])
    found = by_row(P.decode_int_lists(lists, engine=engine))
    assert [r["error"] for r in found] == [None, "varint_too_long"]
    assert found[0]["numbers"] == [-(2**63)] and found[1]["numbers"] is None


_MEMORY = """
import resource, struct, sys
import pyarrow as pa
from tallyline.functions import payload_arrow as A

if sys.argv[1] == "lists":
    payload, decode = bytes([0xFA, 0x0F]) + b"\\x02" * 1021 + b"\\x00", A.int_list_sum.func
else:
    payload = b"\\x02" + struct.pack("<d", 1.5) + bytes([0xEA, 0x0F]) + b"x" * 1013
    decode = A.message.func
column = pa.array([payload] * (1 << 16), pa.binary())
decode(column.slice(0, 1000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = decode(column)
more = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
assert len(found) == 1 << 16 and found.field("error").null_count == 1 << 16
print(more >> 10)
"""


@pytest.mark.parametrize("kind", ["lists", "messages"])
def test_memory_of_a_batch_of_64_mib(kind):
    run = subprocess.run(
        [sys.executable, "-c", _MEMORY, kind], cwd=ROOT, capture_output=True, text=True, check=True
    )
    assert int(run.stdout) < 512


def test_pieces_of_a_batch():
    bounds = np.array([0, 3, 3, 5, 30, 31, 32, 40])
    for size in (1, 4, 10, 39, 40, 100):
        pieces = payload_arrow._pieces(bounds, size)
        assert [a for a, _ in pieces] == [0] + [b for _, b in pieces[:-1]]
        assert pieces[-1][1] == 7
        assert all(b - a == 1 or bounds[b] - bounds[a] <= size for a, b in pieces)
    assert payload_arrow._pieces(np.array([0]), 4) == []


def test_bad_text_among_good():
    texts = [b"ok", b"\xff", "ä".encode(), b"", b"\xc3", b"end"]
    payloads = [b"\x02" + struct.pack("<d", 1.0) + bytes([2 * len(t)]) + t for t in texts]
    found = payload_arrow.message.func(pa.array(payloads, pa.binary())).to_pylist()
    assert [r["content"] for r in found] == ["ok", None, "ä", "", None, "end"]
    assert [r["error"] is None for r in found] == [True, False, True, True, False, True]
