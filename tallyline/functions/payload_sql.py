"""Payload codecs as plain Spark expressions, without Python workers.

They run on request (``engine="sql"``): slower than the Arrow codecs, they need
nothing but the JVM and are the independent second opinion in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.varint import (
    MAX_GROUPS,
    ONE_VARINT,
    TOO_LONG,
    TRUNCATED,
    byte_at,
    to_bytes,
    to_text,
    unzigzag,
    varint_fault,
    varint_size,
    varint_text,
    varint_value,
)

NEGATIVE_LENGTH = "negative_length"
INVALID_UTF8 = "invalid_utf8"
INVALID_BOOLEAN = "invalid_boolean"
INVALID_CHOICE = "invalid_choice"
SUM_OVERFLOW = "sum_overflow"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and used many times."""
    return F.get(F.transform(F.array(value), body), 0)


def _varint_from(value: Column, position: Column) -> Column:
    """struct<n, size, why> of the varint that begins at a 1-based position."""
    text = to_text(F.substring(value, position, F.lit(MAX_GROUPS)))
    return _let(
        F.struct(text.alias("text"), varint_size(text).alias("size")),
        lambda v: F.struct(
            varint_value(v["text"], v["size"]).alias("n"),
            v["size"].alias("size"),
            varint_fault(v["text"], v["size"]).alias("why"),
        ),
    )


def encode_sum(number: Column) -> Column:
    return to_bytes(varint_text(number))


def encode_int_list(numbers: Column) -> Column:
    """One block (count, then the items) and the closing zero; a NULL item
    makes a NULL payload."""
    items = F.array_join(F.transform(numbers, varint_text), "")
    end = F.char(F.lit(0))
    filled = F.concat(varint_text(F.size(numbers)), items, end)
    complete = F.size(F.array_compact(numbers)) == F.size(numbers)
    return to_bytes(
        F.when(complete & (F.size(numbers) > 0), filled).when(F.size(numbers) == 0, end)
    )


def list_sum(numbers: Column) -> Column:
    """64-bit sum, 0 for an empty list, NULL when it does not fit."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, x: F.try_add(total, x))


def decode_sum(value: Column) -> Column:
    """struct<sum, error> from the first varint; later bytes are ignored."""
    return _let(
        _varint_from(value, F.lit(1)),
        lambda v: F.struct(
            F.when(v["why"].isNull(), v["n"]).alias("sum"),
            F.when(value.isNotNull(), v["why"]).alias("error"),
        ),
    )


def decode_int_list(value: Column) -> Column:
    """struct<numbers, error>, all blocks."""

    def read(pieces: Column) -> Column:
        return _let(_piece_numbers(pieces), lambda numbers: blocks(pieces, numbers))

    def blocks(pieces: Column, numbers: Column) -> Column:
        return _let(
            _list_blocks(pieces, numbers),
            lambda found: F.struct(
                _list_items(numbers, found["spans"]).alias("numbers"),
                found["error"].alias("error"),
            ),
        )

    return _let(_varint_pieces(value), read)


def _varint_pieces(value: Column) -> Column:
    """A payload cut behind every varint, as texts; a last one may be cut off."""
    return F.regexp_extract_all(
        to_text(value), F.lit(f"{ONE_VARINT}|[\\x80-\\xFF]+$"), F.lit(0)
    )


def _number(piece: Column) -> Column:
    """The number of a piece; NULL when it is cut off or too long."""
    size = F.length(piece)
    first, second = byte_at(piece, 1).cast("bigint"), byte_at(piece, 2).cast("bigint")
    pair = first.bitwiseAND(F.lit(127)).bitwiseOR(F.shiftleft(second, 7))
    # Of the tenth byte only the lowest bit still fits 64 bits.
    over = (size == MAX_GROUPS) & (byte_at(piece, size) > 1)
    intact = (size <= MAX_GROUPS) & (byte_at(piece, size) < 128) & ~over
    return (
        F.when(size == 1, F.when(first < 128, unzigzag(first)))
        .when(size == 2, F.when(second < 128, unzigzag(pair)))
        .when(intact, varint_value(piece, size))
    )


def _why(piece: Column) -> Column:
    """The fault of a piece that is none of a number, or of none at all."""
    return F.when(F.length(piece) >= MAX_GROUPS, F.lit(TOO_LONG)).otherwise(F.lit(TRUNCATED))


def _piece_numbers(pieces: Column) -> Column:
    return F.transform(pieces, _number)


# What the next varint of an integer list stands for.
_COUNT, _SIZE, _ITEM, _DONE, _BROKEN = range(5)


def _list_blocks(pieces: Column, numbers: Column) -> Column:
    """struct<spans, error>: where the items of each block of a list lie among
    its numbers, or why there is no list."""
    count = F.get(numbers, F.lit(0))
    fits = (count >= 0) & (count <= F.size(numbers) - 2)
    closing = F.get(numbers, F.when(fits, count + 1).cast("int"))
    items = F.slice(numbers, F.lit(2), F.when(fits, count).cast("int"))
    one_block = fits & (closing == 0) & F.forall(items, lambda n: n.isNotNull())
    span = F.struct(F.lit(2).cast("bigint").alias("first"), count.alias("n"))
    no_error = F.lit(None).cast("string").alias("error")
    return (
        F.when(count == 0, F.struct(F.array().cast(_SPANS).alias("spans"), no_error))
        .when(one_block, F.struct(F.array(span).alias("spans"), no_error))
        .when(numbers.isNotNull(), _walk_blocks(pieces, numbers))
    )


_SPANS = "array<struct<first:bigint,n:bigint>>"


def _walk_blocks(pieces: Column, numbers: Column) -> Column:
    """The same, one varint after the other, for lists of any form."""
    bigint = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit(_COUNT).alias("expects"),
        bigint.alias("at"),
        bigint.alias("left"),
        F.array().cast(_SPANS).alias("spans"),
    )

    def step(s: Column, n: Column) -> Column:
        count = s["expects"] == _COUNT
        size = F.abs(F.greatest(n, F.lit(1 - 2**63)))
        expects = (
            F.when(n.isNull(), F.lit(_BROKEN))
            .when(count & (n == 0), F.lit(_DONE))
            .when(count & (n < 0), F.lit(_SIZE))
            .when((s["expects"] == _ITEM) & (s["left"] == 1), F.lit(_COUNT))
            .otherwise(F.lit(_ITEM))
        )
        left = F.when(count, size).when(s["expects"] == _ITEM, s["left"] - 1)
        span = F.struct(
            (s["at"] + F.when(n < 0, 3).otherwise(2)).alias("first"), size.alias("n")
        )
        return F.when(s["expects"] >= _DONE, s).otherwise(
            F.struct(
                expects.alias("expects"),
                (s["at"] + 1).alias("at"),
                left.otherwise(s["left"]).alias("left"),
                F.when(count & (n != 0), F.array_append(s["spans"], span))
                .otherwise(s["spans"])
                .alias("spans"),
            )
        )

    def finish(s: Column) -> Column:
        done = s["expects"] == _DONE
        fault = F.when(s["expects"] == _BROKEN, _why(F.get(pieces, (s["at"] - 1).cast("int"))))
        return F.struct(
            F.when(done, s["spans"]).alias("spans"),
            F.when(~done, F.coalesce(fault, F.lit(TRUNCATED))).alias("error"),
        )

    return F.aggregate(numbers, start, step, finish)


def _list_items(numbers: Column, spans: Column) -> Column:
    """The items at ``spans``, in order."""
    return F.flatten(
        F.transform(
            spans,
            lambda s: F.slice(numbers, s["first"].cast("int"), s["n"].cast("int")),
        )
    )


def double_from_bytes(eight: Column) -> Column:
    """Little-endian IEEE double from sign, exponent and fraction."""
    big_endian = F.hex(to_bytes(F.reverse(to_text(eight))))
    high = F.conv(F.substring(big_endian, 1, 4), 16, 10).cast("bigint")
    fraction = F.conv(F.substring(big_endian, 4, 13), 16, 10).cast("bigint")
    exponent = F.shiftright(high, 4).bitwiseAND(F.lit(2047))
    sign = F.when(high >= 32768, F.lit(-1.0)).otherwise(F.lit(1.0))
    two = F.lit(2.0)
    normal = (fraction + F.lit(2**52)).cast("double") * F.pow(two, (exponent - 1075).cast("double"))
    size = (
        F.when(exponent == 0, fraction.cast("double") * F.pow(two, F.lit(-1074.0)))
        .when(exponent < 2047, normal)
        .when(fraction == 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )
    return sign * size


def decode_message(value: Column) -> Column:
    """struct<message_id, event_time, content, error>."""

    def read(first: Column) -> Column:
        return _let(
            F.struct(
                first.alias("id"),
                _varint_from(value, first["size"] + 9).alias("length"),
            ),
            checked,
        )

    def checked(head: Column) -> Column:
        length = head["length"]["n"]
        text_at = head["id"]["size"] + 9 + head["length"]["size"]
        left = F.octet_length(value) - text_at + 1
        inside = F.greatest(F.lit(0), F.least(length, left)).cast("int")
        raw = F.substring(value, text_at, inside)
        error = (
            F.when(head["id"]["why"].isNotNull(), head["id"]["why"])
            .when(F.octet_length(value) < head["id"]["size"] + 8, F.lit(TRUNCATED))
            .when(head["length"]["why"].isNotNull(), head["length"]["why"])
            .when(length < 0, F.lit(NEGATIVE_LENGTH))
            .when(length > left, F.lit(TRUNCATED))
            .when(~F.is_valid_utf8(raw.cast("string")), F.lit(INVALID_UTF8))
        )
        eight = F.substring(value, head["id"]["size"] + 1, F.lit(8))
        return _let(
            F.struct(error.alias("error"), raw.alias("raw")),
            lambda v: F.struct(
                F.when(v["error"].isNull(), head["id"]["n"]).alias("message_id"),
                F.when(v["error"].isNull(), double_from_bytes(eight)).alias("event_time"),
                F.when(v["error"].isNull(), v["raw"].cast("string")).alias("content"),
                v["error"].alias("error"),
            ),
        )

    return F.when(value.isNotNull(), _let(_varint_from(value, F.lit(1)), read))
