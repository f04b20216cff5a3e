"""Scalar expressions for messages and counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed texts of the message family.
CONTENT_PREFIX = "Message "
MESSAGE_LINE = "New message: [ID=%d] %s at %s"
LATENCY_LINE = "Latency: %s seconds"


def epoch_seconds(ts: Column) -> Column:
    """Wall-clock time as seconds since 1970, a double. Takes a TIMESTAMP."""
    return F.unix_micros(ts).cast("double") / F.lit(1e6)


def epoch_seconds_from_millis(millis: Column) -> Column:
    return millis.cast("double") / F.lit(1000.0)


def to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * F.lit(1e6)).cast("bigint"))


def message_content(message_id: Column) -> Column:
    return F.concat(F.lit(CONTENT_PREFIX), message_id.cast("string"))


def latency(received: Column, event_time: Column) -> Column:
    return received - event_time


def seconds_text(seconds: Column, style: str = "fixed") -> Column:
    """Three decimals; ``rounded`` drops zeros after the first one."""
    text = F.format_string("%.3f", seconds)
    if style == "fixed":
        return text
    if style == "rounded":
        return F.regexp_replace(text, "0{1,2}$", "")
    raise ValueError(f"style must be 'fixed' or 'rounded', got {style!r}")


def per_second(count: Column, seconds: int) -> Column:
    """Whole records per second, rounded down."""
    return F.call_function("div", count, F.lit(seconds))


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent, rounded down."""
    return F.call_function("div", done * F.lit(100), total)


def remaining(end: Column, committed: Column) -> Column:
    """Records still to be read, never below zero."""
    return F.greatest(F.lit(0).cast("bigint"), end - committed)
