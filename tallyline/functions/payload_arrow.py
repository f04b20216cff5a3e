"""Payload codecs as Arrow functions: one call per batch, NumPy over its buffers.

Each function takes only the payload column; keys, partitions and offsets stay
in the JVM. All rows of a batch advance together, so the number of Python steps
depends on the blocks per list and the groups per number, not on the rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.payload_sql import (
    INVALID_BOOLEAN,
    INVALID_CHOICE,
    INVALID_UTF8,
    NEGATIVE_LENGTH,
    SUM_OVERFLOW,
)
from tallyline.functions.varint import MAX_GROUPS, TOO_LONG, TRUNCATED

# Ship the functions themselves, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


PIECE = 4 << 20  # payload bytes that are decoded at once


def _once(returns: T.DataType):
    """An Arrow function that Spark must not compute twice for one row, which it
    would do to test ``error`` below a projection that uses the other fields."""
    return lambda body: F.arrow_udf(returns)(body).asNondeterministic()


def _pieces(bounds: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row is a run by itself."""
    marks = np.arange(size, bounds[-1], size)
    after = np.searchsorted(bounds, marks, side="right")
    edges = np.unique(np.concatenate(([0], after - 1, after, [bounds.size - 1])))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _decoder(returns: T.DataType):
    """A function over payloads that takes a batch piece by piece. Decoding needs
    many times the size of its input, so the size of a piece bounds its memory,
    whatever the session allows a batch. A single longer payload goes beyond, but
    where lists are only summed."""

    def wrap(body):
        def decode(column: pa.Array) -> pa.Array:
            pieces = _pieces(_bytes_of(column)[1], PIECE)
            if len(pieces) < 2:
                return body(column)
            return pa.concat_arrays([body(column.slice(a, b - a)) for a, b in pieces])

        return _once(returns)(decode)

    return wrap


REASONS = [
    TRUNCATED, TOO_LONG, NEGATIVE_LENGTH, INVALID_UTF8, SUM_OVERFLOW, INVALID_BOOLEAN,
    INVALID_CHOICE,
]
_TRUNCATED, _TOO_LONG, _NEGATIVE, _UTF8, _OVERFLOW, _BOOLEAN, _CHOICE = range(7)
_FINE = -1


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes of a batch and the n + 1 row bounds in them."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    width = np.int64 if large else np.int32
    bounds = np.frombuffer(column.buffers()[1], dtype=width)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _running(values: np.ndarray) -> np.ndarray:
    """Running sum with a leading zero: the sum of a range is a difference."""
    out = np.zeros(values.size + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _unfold(folded: np.ndarray) -> np.ndarray:
    sign = (folded & np.uint64(1)).view(np.int64)
    return (folded >> np.uint64(1)).view(np.int64) ^ -sign


def _numbers_at(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers whose varints begin at ``start`` and have ``size`` bytes."""
    folded = (data[start] & 0x7F).astype(np.uint64)
    longer = np.flatnonzero(size > 1)
    for group in range(1, MAX_GROUPS):
        if not longer.size:
            break
        bits = (data[start[longer] + group] & 0x7F).astype(np.uint64)
        folded[longer] |= bits << np.uint64(7 * group)
        longer = longer[size[longer] > group + 1]
    return _unfold(folded)


def _reasons(fault: np.ndarray, nulls: np.ndarray) -> pa.Array:
    """Reason texts; rows without a fault, and null payloads, have none."""
    fine = nulls | (fault == _FINE)
    if fine.all():
        return pa.nulls(fault.size, pa.string())
    return pa.array(REASONS, pa.string()).take(pa.array(fault, pa.int32(), mask=fine))


def _nulls(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


class _Varints:
    """All varints of a batch, in order, none reaching over the end of a row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        closes = data < 0x80
        row_ends = bounds[1:][np.diff(bounds) > 0] - 1
        cut = row_ends[~closes[row_ends]]
        closes[row_ends] = True
        end = np.flatnonzero(closes)
        start = np.concatenate(([0], end[:-1] + 1)) if end.size else end
        size = end - start + 1
        before = _running(closes)
        self.of_row = before[bounds]
        whole = np.ones(end.size, dtype=bool)
        whole[before[cut]] = False
        self.too_long = (size > MAX_GROUPS) | (~whole & (size == MAX_GROUPS))
        # Of the tenth byte only the lowest bit still fits 64 bits.
        self.too_long |= (size == MAX_GROUPS) & (data[end] > 1)
        self.broken = ~whole | self.too_long
        self.number = _numbers_at(data, start, np.minimum(size, MAX_GROUPS))


def _one_block(varints: _Varints) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, at first sight, are a single closed block or the bare zero,
    as nearly all are; and where their closing zero lies."""
    first, limit = varints.of_row[:-1], varints.of_row[1:]
    if not varints.number.size:
        return np.zeros(first.size, dtype=bool), first
    last = varints.number.size - 1
    count = varints.number[np.minimum(first, last)]
    inside = (first < limit) & (count >= 0) & (count < limit - first)
    close = np.where(inside, first + np.where(count > 0, 1 + count, 0), first)
    closed = inside & (close < limit) & (varints.number[np.minimum(close, last)] == 0)
    return closed, close


def _block_starts(number: np.ndarray, first: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Where blocks, and closing zeros, begin in rows of any form. Every varint
    points to where the next block would begin if it were a count itself; the
    pointers are followed from the first varint of each row in strides of 1, 2,
    4, ... blocks, so the rounds grow with the logarithm of the blocks."""
    here = np.arange(number.size)
    room = np.repeat(limit, limit - first) - here
    size = np.where((number > room) | (number < -room), room, np.abs(number))
    step = here + np.where(number == 0, 0, 1 + size + (number < 0))
    stride = np.append(np.where(step < here + room, step, number.size), number.size)
    seen = np.zeros(number.size + 1, dtype=bool)
    seen[first[first < limit]] = True
    before = 0
    while (found := np.count_nonzero(seen)) > before:
        before = found
        seen[stride[seen]] = True
        stride = stride[stride]
    return np.flatnonzero(seen[:-1])


def _read_lists(varints: _Varints):
    """(row, first item, end of items) of every block, and the fault of each
    row. A row is read up to its closing zero, and has a fault if it has none or
    if a broken varint comes before it."""
    first, limit = varints.of_row[:-1], varints.of_row[1:]
    simple, close = _one_block(varints)
    close = np.where(simple, close, limit)
    blocks = [(np.flatnonzero(simple), first[simple] + 1, close[simple])]
    odd = np.flatnonzero(~simple)
    if odd.size:
        # The varints of the other rows on their own, then back to their places.
        kept = np.repeat(~simple, limit - first)
        place = np.flatnonzero(kept)
        bounds = _running((limit - first)[odd])
        starts = _block_starts(varints.number[kept], bounds[:-1], bounds[1:])
        row = odd[np.searchsorted(bounds, starts, side="right") - 1]
        at, count = place[starts], varints.number[place[starts]]
        close[row[count == 0]] = at[count == 0]
        row, at, count = row[count != 0], at[count != 0], count[count != 0]
        items = at + 1 + (count < 0)
        blocks.append((row, items, items + np.abs(count)))
    fault = np.where(close < limit, _FINE, _TRUNCATED)
    if varints.broken.any():
        bad = np.append(np.flatnonzero(varints.broken), varints.number.size)
        stop = bad[np.searchsorted(bad, first)]
        broken = stop < np.minimum(close + 1, limit)
        too_long = np.append(varints.too_long, False)[stop]
        fault[broken] = np.where(too_long, _TOO_LONG, _TRUNCATED)[broken]
    row, items, end = (np.concatenate(parts) for parts in zip(*blocks, strict=True))
    fine = fault[row] == _FINE
    return row[fine], items[fine], np.maximum(items[fine], end[fine]), fault


_SUM = T.StructType().add("sum", T.LongType()).add("error", T.StringType())
_ENCODED = T.StructType().add("value", T.BinaryType()).add("error", T.StringType())
_LIST = T.StructType().add("numbers", T.ArrayType(T.LongType())).add("error", T.StringType())
_MESSAGE = (
    T.StructType()
    .add("message_id", T.LongType())
    .add("event_time", T.DoubleType())
    .add("content", T.StringType())
    .add("error", T.StringType())
)


def _sum_long(data: np.ndarray) -> tuple[int, int]:
    """Sum and fault of one payload of any length, read a piece at a time: a block goes
    on in the next piece, and so does a varint that the end of a piece cuts."""
    at, left, sized, total = 0, 0, False, 0
    while at < data.size:
        piece = data[at : at + PIECE]
        end = np.flatnonzero(piece < 0x80)
        if not end.size:
            return 0, _TOO_LONG if piece.size >= MAX_GROUPS else _TRUNCATED
        start = np.concatenate(([0], end[:-1] + 1))
        size = end - start + 1
        broken = (size > MAX_GROUPS) | ((size == MAX_GROUPS) & (piece[end] > 1))
        stop = int(broken.argmax()) if broken.any() else size.size
        number = _numbers_at(piece, start[:stop], size[:stop])
        i = 0
        while i < stop:
            if left and not sized:
                taken = number[i : i + left]
                total += int((taken & 0xFFFFFFFF).sum()) + (int((taken >> 32).sum()) << 32)
                left -= taken.size
                i += taken.size
                continue
            # A count, or the byte size behind a negative one, which is passed over.
            if not sized:
                left = abs(int(number[i]))
                if not left:
                    return total, _FINE if -(2**63) <= total < 2**63 else _OVERFLOW
            sized = not sized and number[i] < 0
            i += 1
        if stop < size.size:
            return 0, _TOO_LONG
        at += int(end[-1]) + 1
    return 0, _TRUNCATED


def _sum_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if len(column) == 1 and (data := _bytes_of(column)[0]).size > PIECE:
        total, reason = _sum_long(data)
        total = total if reason == _FINE else 0
        return np.array([total], np.int64), np.array([reason], np.int32)
    varints = _Varints(*_bytes_of(column))
    row, first, end, fault = _read_lists(varints)

    def sums(values: np.ndarray) -> np.ndarray:
        upto, total = _running(values), np.zeros(len(column), dtype=np.int64)
        np.add.at(total, row, upto[end] - upto[first])
        return total

    number = varints.number
    if not number.size or max(-int(number.min()), int(number.max())) * number.size < 2**62:
        return sums(number), fault
    # Halves keep the running sums themselves from overflowing.
    low, high = sums(number & 0xFFFFFFFF), sums(number >> 32)
    high += low >> 32
    fault[(fault == _FINE) & (high != high.astype(np.int32))] = _OVERFLOW
    return (high << 32) | (low & 0xFFFFFFFF), fault


@_decoder(_SUM)
def int_list_sum(column: pa.Array) -> pa.Array:
    total, fault = _sum_lists(column)
    nulls = _nulls(column)
    return pa.StructArray.from_arrays(
        [pa.array(total, mask=nulls | (fault != _FINE)), _reasons(fault, nulls)],
        ["sum", "error"],
    )


@_decoder(_ENCODED)
def int_list_sum_bytes(column: pa.Array) -> pa.Array:
    """The sum already encoded: the whole work of the stream sum in one call."""
    total, fault = _sum_lists(column)
    nulls = _nulls(column)
    sums = _binary(*_varint_bytes(total), nulls | (fault != _FINE))
    return pa.StructArray.from_arrays([sums, _reasons(fault, nulls)], ["value", "error"])


@_decoder(_LIST)
def int_list(column: pa.Array) -> pa.Array:
    varints = _Varints(*_bytes_of(column))
    row, first, end, fault = _read_lists(varints)
    edges = np.zeros(varints.number.size + 1, dtype=np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, end, -1)
    length = np.zeros(len(column), dtype=np.int64)
    np.add.at(length, row, end - first)
    nulls = _nulls(column)
    lists = pa.ListArray.from_arrays(
        pa.array(_running(length).astype(np.int32)),
        pa.array(varints.number[np.cumsum(edges[:-1]) > 0]),
        mask=pa.array(nulls | (fault != _FINE)),
    )
    return pa.StructArray.from_arrays([lists, _reasons(fault, nulls)], ["numbers", "error"])


class _Cursor:
    """A read position in every row of a batch, and the first fault met."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = np.concatenate((data, np.zeros(MAX_GROUPS, dtype=np.uint8)))
        self.at, self.end = bounds[:-1].copy(), bounds[1:]
        self.fault = np.full(self.at.size, _FINE, dtype=np.int32)

    def fail(self, rows: np.ndarray, reason: int) -> None:
        self.fault[rows & (self.fault == _FINE)] = reason
        self.at = np.where(self.fault == _FINE, self.at, self.end)

    def varint(self) -> np.ndarray:
        window = self.data[self.at[:, None] + np.arange(MAX_GROUPS)] < 0x80
        size = np.where(window.any(axis=1), window.argmax(axis=1) + 1, MAX_GROUPS + 1)
        room = self.end - self.at
        beyond = (size == MAX_GROUPS) & (self.data[self.at + MAX_GROUPS - 1] > 1)
        self.fail(((size > MAX_GROUPS) | beyond) & (room >= MAX_GROUPS), _TOO_LONG)
        self.fail(size > room, _TRUNCATED)
        size = np.where(self.fault == _FINE, size, 1)
        number = _numbers_at(self.data, self.at, size)
        self.at = np.minimum(self.at + size, self.end)
        return number

    def double(self) -> np.ndarray:
        self.fail(self.end - self.at < 8, _TRUNCATED)
        eight = self.data[self.at[:, None] + np.arange(8)]
        self.at = np.minimum(self.at + 8, self.end)
        return np.ascontiguousarray(eight).view("<f8")[:, 0]

    def raw(self, length: np.ndarray) -> pa.Array:
        """So many bytes of each row, as they are."""
        self.fail(length < 0, _NEGATIVE)
        self.fail(length > self.end - self.at, _TRUNCATED)
        length = np.where(self.fault == _FINE, length, 0)
        bounds = _running(length)
        take = np.arange(bounds[-1]) + np.repeat(self.at - bounds[:-1], length)
        self.at = self.at + length
        return pa.Array.from_buffers(
            pa.large_binary(),
            length.size,
            [None, pa.py_buffer(bounds), pa.py_buffer(self.data[take])],
        )

    def text(self) -> pa.Array:
        raw = self.raw(self.varint())
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return self._valid_text(raw)

    def _valid_text(self, raw: pa.Array) -> pa.Array:
        """For a batch that holds bytes that are no UTF-8: halved again and again,
        until such rows stand alone."""
        texts, wrong = [], np.zeros(len(raw), dtype=bool)
        spans = [(0, len(raw))]
        while spans:
            begin, end = spans.pop()
            try:
                texts.append(raw.slice(begin, end - begin).cast(pa.large_string()))
            except pa.ArrowInvalid:
                if end - begin == 1:
                    wrong[begin] = True
                    texts.append(pa.array([""], pa.large_string()))
                else:
                    middle = (begin + end) // 2
                    spans += [(middle, end), (begin, middle)]
        self.fail(wrong, _UTF8)
        return pa.concat_arrays(texts).cast(pa.string())


    def of(self, rows: np.ndarray) -> _Cursor:
        """A cursor over some of the rows, which are read on by it alone."""
        part = object.__new__(_Cursor)
        part.data, part.at, part.end = self.data, self.at[rows], self.end[rows]
        part.fault = self.fault[rows]
        return part

    def back(self, rows: np.ndarray, part: _Cursor) -> None:
        self.at[rows], self.fault[rows] = part.at, part.fault

    def one_byte(self) -> np.ndarray:
        self.fail(self.end - self.at < 1, _TRUNCATED)
        byte = self.data[self.at]
        self.at = np.minimum(self.at + 1, self.end)
        return byte

    def four(self) -> np.ndarray:
        self.fail(self.end - self.at < 4, _TRUNCATED)
        four = self.data[self.at[:, None] + np.arange(4)]
        self.at = np.minimum(self.at + 4, self.end)
        return np.ascontiguousarray(four).view("<f4")[:, 0]


@_decoder(_MESSAGE)
def message(column: pa.Array) -> pa.Array:
    cursor = _Cursor(*_bytes_of(column))
    message_id, event_time, content = cursor.varint(), cursor.double(), cursor.text()
    nulls = _nulls(column)
    gone = nulls | (cursor.fault != _FINE)
    content = pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), content)
    return pa.StructArray.from_arrays(
        [
            pa.array(message_id, mask=gone),
            pa.array(event_time, mask=gone),
            content,
            _reasons(cursor.fault, nulls),
        ],
        ["message_id", "event_time", "content", "error"],
    )


@_decoder(_SUM)
def leading_number(column: pa.Array) -> pa.Array:
    cursor = _Cursor(*_bytes_of(column))
    number = cursor.varint()
    nulls = _nulls(column)
    return pa.StructArray.from_arrays(
        [pa.array(number, mask=nulls | (cursor.fault != _FINE)), _reasons(cursor.fault, nulls)],
        ["sum", "error"],
    )


def _varint_bytes(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints of many numbers end to end, and the n + 1 bounds between them."""
    folded = ((number << 1) ^ (number >> 63)).view(np.uint64)
    size = np.ones(number.size, dtype=np.int64)
    longer, groups = np.flatnonzero(folded >> np.uint64(7)), 1
    while longer.size:
        size[longer] += 1
        groups += 1
        if groups == MAX_GROUPS:
            break
        longer = longer[(folded[longer] >> np.uint64(7 * groups)) != 0]
    bounds = _running(size)
    data = np.empty(bounds[-1], dtype=np.uint8)
    start, rest = bounds[:-1], folded
    for _ in range(groups):
        more = size > 1
        data[start] = (rest & np.uint64(0x7F)).astype(np.uint8) | (more.view(np.uint8) << 7)
        start, rest, size = start[more] + 1, rest[more] >> np.uint64(7), size[more] - 1
    return data, bounds


def _binary(data: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> pa.Array:
    """Row payloads as an Arrow column; ``gone`` rows become NULL."""
    valid = None
    if gone.any():
        valid = pa.py_buffer(np.packbits(~gone, bitorder="little"))
    buffers = [valid, pa.py_buffer(bounds), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), gone.size, buffers).cast(pa.binary())


@_once(T.BinaryType())
def number_bytes(column: pa.Array) -> pa.Array:
    return _binary(*_varint_bytes(_filled(column, np.int64)), _nulls(column))


@_once(T.BinaryType())
def int_list_bytes(column: pa.Array) -> pa.Array:
    """One block and the closing zero; a NULL item makes a NULL payload."""
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    items, gone = column.flatten(), _nulls(column)
    if items.null_count:
        missing = _running(_nulls(items))
        edges = _running(length)
        gone = gone | (missing[edges[1:]] > missing[edges[:-1]])
    numbers_in_row = np.where(length > 0, length + 2, 1)
    edges = _running(numbers_in_row)
    number = np.zeros(edges[-1], dtype=np.int64)
    is_item = np.ones(edges[-1], dtype=bool)
    is_item[edges[1:] - 1] = False
    filled = edges[:-1][length > 0]
    is_item[filled] = False
    number[filled] = length[length > 0]
    number[is_item] = _filled(items, np.int64)
    data, bounds = _varint_bytes(number)
    return _binary(data, bounds[edges], gone)


@_once(T.BinaryType())
def message_bytes(message_id: pa.Array, event_time: pa.Array, content: pa.Array) -> pa.Array:
    """Varint id, eight bytes of time, sized text; NULL where a field is."""
    text, text_bounds = _bytes_of(content)
    time = np.ascontiguousarray(_filled(event_time, "<f8")).view(np.uint8)
    parts = [
        _varint_bytes(_filled(message_id, np.int64)),
        (time, np.arange(len(event_time) + 1, dtype=np.int64) * 8),
        _varint_bytes(np.diff(text_bounds)),
        (text, text_bounds),
    ]
    gone = _nulls(message_id) | _nulls(event_time) | _nulls(content)
    return _binary(*_joined(parts), gone)


# Records of any flat shape -----------------------------------------------------------


def _field(cursor: _Cursor, kind) -> pa.Array:
    """The next field of every row. Rows with a fault have any value."""
    if isinstance(kind, tuple):
        form, detail = kind
        if form == "array":
            return _items(cursor, detail)
        if form == "fixed":
            return cursor.raw(np.full(cursor.at.size, detail)).cast(pa.binary())
        if form == "enum":
            choice = cursor.varint()
            cursor.fail((choice < 0) | (choice >= len(detail)), _CHOICE)
            choice = np.where(cursor.fault == _FINE, choice, 0)
            return pa.array(detail, pa.string()).take(pa.array(choice))
        return _optional(cursor, form, detail)
    if kind in ("int", "long"):
        return pa.array(cursor.varint())
    if kind == "double":
        return pa.array(cursor.double())
    if kind == "float":
        return pa.array(cursor.four())
    if kind == "boolean":
        byte = cursor.one_byte()
        cursor.fail(byte > 1, _BOOLEAN)
        return pa.array(byte == 1)
    if kind == "bytes":
        return cursor.raw(cursor.varint()).cast(pa.binary())
    return cursor.text()


def _optional(cursor: _Cursor, absent: int, kind) -> pa.Array:
    """A field that is there or not, as the number before it says."""
    choice = cursor.varint()
    cursor.fail((choice != 0) & (choice != 1), _CHOICE)
    here = (choice != absent) & (cursor.fault == _FINE)
    rows = np.flatnonzero(here)
    part = cursor.of(rows)
    found = _field(part, kind)
    cursor.back(rows, part)
    place = np.cumsum(here) - 1
    return found.take(pa.array(place, mask=~here))


def _items(cursor: _Cursor, kind) -> pa.Array:
    """Arrays in blocks. All rows that have another block read its count, then all that
    have another item read one: the steps depend on the longest array of a piece."""
    size = cursor.at.size
    left, open_ = np.zeros(size, np.int64), np.ones(size, bool)
    parts, owners = [], []
    while True:
        rows = np.flatnonzero(open_ & (left == 0) & (cursor.fault == _FINE))
        if rows.size:
            part = cursor.of(rows)
            count = part.varint()
            sized = np.flatnonzero((count < 0) & (part.fault == _FINE))
            inner = part.of(sized)
            inner.varint()  # the byte size of the block
            part.back(sized, inner)
            cursor.back(rows, part)
            left[rows] = np.abs(count)
            open_[rows] = count != 0
        rows = np.flatnonzero(open_ & (left > 0) & (cursor.fault == _FINE))
        if not rows.size:
            break
        part = cursor.of(rows)
        parts.append(_field(part, kind))
        owners.append(rows)
        cursor.back(rows, part)
        left[rows] -= 1
    if not parts:
        bounds = pa.array(np.zeros(size + 1, np.int32))
        return pa.ListArray.from_arrays(bounds, pa.array([], _arrow_type(kind)))
    owner = np.concatenate(owners)
    items = pa.concat_arrays(parts).take(pa.array(np.argsort(owner, kind="stable")))
    lengths = np.bincount(owner, minlength=size)
    return pa.ListArray.from_arrays(pa.array(_running(lengths).astype(np.int32)), items)


_PLAIN = {
    "int": (T.LongType(), pa.int64()),
    "long": (T.LongType(), pa.int64()),
    "double": (T.DoubleType(), pa.float64()),
    "float": (T.FloatType(), pa.float32()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "bytes": (T.BinaryType(), pa.binary()),
    "string": (T.StringType(), pa.string()),
}


def _arrow_type(kind) -> pa.DataType:
    if not isinstance(kind, tuple):
        return _PLAIN[kind][1]
    form, detail = kind
    if form == "array":
        return pa.list_(_arrow_type(detail))
    return {"fixed": pa.binary(), "enum": pa.string()}.get(form) or _arrow_type(detail)


def _spark_type(kind) -> T.DataType:
    if not isinstance(kind, tuple):
        return _PLAIN[kind][0]
    form, detail = kind
    if form == "array":
        return T.ArrayType(_spark_type(detail))
    return {"fixed": T.BinaryType(), "enum": T.StringType()}.get(form) or _spark_type(detail)


def record(kinds: list):
    """A decoder for records of these fields, named ``f0``, ``f1``, ... and ``error``. A
    kind is a name, or one of ("array", kind), ("fixed", bytes), ("enum", symbols) and
    (0 or 1, kind), an optional field, with the number that says it is absent."""
    names = [f"f{i}" for i in range(len(kinds))]
    returns = T.StructType()
    for name, kind in zip(names, kinds, strict=True):
        returns = returns.add(name, _spark_type(kind))
    types = [_arrow_type(kind) for kind in kinds]

    @_decoder(returns.add("error", T.StringType()))
    def read(column: pa.Array) -> pa.Array:
        cursor = _Cursor(*_bytes_of(column))
        fields = [_field(cursor, kind) for kind in kinds]
        nulls = _nulls(column)
        gone = pa.array(nulls | (cursor.fault != _FINE))
        kept = [
            pc.if_else(gone, pa.scalar(None, kind), field.cast(kind))
            for field, kind in zip(fields, types, strict=True)
        ]
        return pa.StructArray.from_arrays(
            [*kept, _reasons(cursor.fault, nulls)], [*names, "error"]
        )

    return read


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the bytes of all parts, one behind the other."""
    sizes = [np.diff(bounds) for _, bounds in parts]
    row_bounds = _running(sum(sizes))
    data = np.empty(row_bounds[-1], dtype=np.uint8)
    start = row_bounds[:-1].copy()
    for (part, bounds), size in zip(parts, sizes, strict=True):
        data[np.arange(part.size) + np.repeat(start - bounds[:-1], size)] = part
        start += size
    return data, row_bounds


def _field_bytes(column: pa.Array, kind) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Bytes of a field of every row, and the rows that cannot be written."""
    gone = _nulls(column)
    fixed = np.arange(len(column) + 1, dtype=np.int64)
    if isinstance(kind, tuple):
        form, detail = kind
        if form == "array":
            return _item_bytes(column, detail)
        if form == "fixed":
            data, bounds = _bytes_of(pc.fill_null(column, bytes(detail)))
            return (data, bounds), gone | (np.diff(bounds) != detail)
        if form == "enum":
            choice = pc.index_in(column, pa.array(detail, column.type))
            return _varint_bytes(_filled(choice, np.int64)), gone | _nulls(choice)
        (data, bounds), bad = _field_bytes(column, detail)
        size = np.where(gone, 0, np.diff(bounds))
        kept = (data[np.repeat(~gone, np.diff(bounds))], _running(size))
        choice = _varint_bytes(np.where(gone, form, 1 - form).astype(np.int64))
        return _joined([choice, kept]), bad & ~gone
    if kind in ("int", "long"):
        return _varint_bytes(_filled(column, np.int64)), gone
    if kind in ("double", "float"):
        width = 8 if kind == "double" else 4
        values = np.ascontiguousarray(_filled(column, f"<f{width}"))
        return (values.view(np.uint8), fixed * width), gone
    if kind == "boolean":
        values = column.fill_null(False).to_numpy(zero_copy_only=False)
        return (values.astype(np.uint8), fixed), gone
    data, bounds = _bytes_of(pc.fill_null(column, "" if kind == "string" else b""))
    return _joined([_varint_bytes(np.diff(bounds)), (data, bounds)]), gone


def _item_bytes(column: pa.Array, kind) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """One block and the closing zero; an empty array is the zero alone."""
    gone = _nulls(column)
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    edges = _running(length)
    (data, bounds), bad = _field_bytes(column.flatten(), kind)
    bad = _running(bad)
    count, count_bounds = _varint_bytes(length.astype(np.int64))
    head = np.where(length > 0, np.diff(count_bounds), 0)
    count = count[np.repeat(length > 0, np.diff(count_bounds))]
    close = (np.zeros(len(column), np.uint8), np.arange(len(column) + 1, dtype=np.int64))
    joined = _joined([(count, _running(head)), (data, bounds[edges]), close])
    return joined, gone | (bad[edges[1:]] > bad[edges[:-1]])


def record_bytes(kinds: list):
    """An encoder for records of these fields, see ``record``; a NULL where the record
    has to have a value, and a value that a field cannot hold, make a NULL payload."""

    @_once(T.BinaryType())
    def write(*columns: pa.Array) -> pa.Array:
        made = [_field_bytes(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        gone = np.logical_or.reduce([bad for _, bad in made])
        return _binary(*_joined([parts for parts, _ in made]), gone)

    return write


def _filled(column: pa.Array, dtype) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype, copy=False)
