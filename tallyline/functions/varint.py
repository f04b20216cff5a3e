"""Zig-zag variable-length whole numbers as Spark column expressions.

A number is folded to an unsigned one (0, -1, 1, -2 become 0, 1, 2, 3) and cut
into groups of seven bits, lowest group first; the high bit of a byte says that
another group follows. Between the bit arithmetic and the BINARY column the
bytes travel as ISO-8859-1 text, one character per byte, because that is the
form in which Spark can look at and join single bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wire format.
LATIN1 = "ISO-8859-1"
MAX_GROUPS = 10
ONE_VARINT = "[\\x80-\\xFF]*[\\x00-\\x7F]"

TRUNCATED = "truncated"
TOO_LONG = "varint_too_long"


def zigzag(number: Column) -> Column:
    number = number.cast("bigint")
    return F.shiftleft(number, 1).bitwiseXOR(F.shiftright(number, 63))


def unzigzag(folded: Column) -> Column:
    sign = -folded.bitwiseAND(F.lit(1))
    return F.shiftrightunsigned(folded, 1).bitwiseXOR(sign)


def varint_text(number: Column) -> Column:
    """The varint of ``number`` as one character per byte."""
    folded = zigzag(number)

    def rest(groups: int) -> Column:
        return F.shiftrightunsigned(folded, 7 * groups)

    def group(index: int) -> Column:
        bits = rest(index).bitwiseAND(F.lit(127))
        more = F.when(rest(index + 1) == 0, F.lit(0)).otherwise(F.lit(128))
        return F.char(bits.bitwiseOR(more))

    last = MAX_GROUPS - 1
    later = [F.when(rest(i) != 0, group(i)).otherwise(F.lit("")) for i in range(2, last)]
    later.append(F.when(rest(last) != 0, F.char(rest(last))).otherwise(F.lit("")))
    return (
        F.when(rest(1) == 0, F.char(folded))
        .when(rest(2) == 0, F.concat(group(0), F.char(rest(1))))
        .otherwise(F.concat(group(0), group(1), *later))
    )


def to_bytes(text: Column) -> Column:
    return F.encode(text, LATIN1)


def to_text(payload: Column) -> Column:
    return F.decode(payload, LATIN1)


def byte_at(text: Column, position: int | Column) -> Column:
    """Byte at a 1-based position; 0 past the end of the text."""
    return F.ascii(F.substring(text, position, F.lit(1)))


def varint_size(text: Column) -> Column:
    """Number of bytes up to the first byte without a high bit, 11 when the
    first ten all have one. A text that stops early yields length + 1."""
    size = F.when(byte_at(text, 1) < 128, F.lit(1))
    for position in range(2, MAX_GROUPS + 1):
        size = size.when(byte_at(text, position) < 128, F.lit(position))
    return size.otherwise(F.lit(MAX_GROUPS + 1))


def varint_value(text: Column, size: Column) -> Column:
    """Number held in the first ``size`` bytes of the text."""
    folded = byte_at(text, 1).cast("bigint").bitwiseAND(F.lit(127))
    for index in range(1, MAX_GROUPS):
        bits = byte_at(text, index + 1).cast("bigint").bitwiseAND(F.lit(127))
        part = F.when(size > index, F.shiftleft(bits, 7 * index)).otherwise(F.lit(0))
        folded = folded.bitwiseOR(part)
    return unzigzag(folded)


def varint_fault(text: Column, size: Column) -> Column:
    """Why the varint at the front cannot be read; NULL when it can."""
    over = (size == MAX_GROUPS) & (byte_at(text, MAX_GROUPS) > 1)
    return F.when((size > MAX_GROUPS) | over, F.lit(TOO_LONG)).when(
        size > F.length(text), F.lit(TRUNCATED)
    )
