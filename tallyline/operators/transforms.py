"""Projections over decoded messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars


def receipt_time(df: DataFrame) -> Column:
    """Epoch seconds at which a record was received: the row's time where the broker
    set it (time type 1) or nothing is known of its kind, else the clock, since
    the producer's time says nothing about receipt."""
    if "timestamp" not in df.columns:
        return scalars.epoch_seconds(F.current_timestamp())
    at = F.col("timestamp")
    if "timestampType" in df.columns:
        at = F.when(F.col("timestampType") == 1, at).otherwise(F.current_timestamp())
    return scalars.epoch_seconds(at)


def with_latency(df: DataFrame, received: Column | None = None) -> DataFrame:
    """Adds ``received_time`` and ``latency`` in seconds; ``receipt_time`` counts
    where no ``received`` is given."""
    df = df.withColumn("received_time", receipt_time(df) if received is None else received)
    return df.withColumn("latency", scalars.latency(F.col("received_time"), F.col("event_time")))


def format_report(df: DataFrame, style: str = "fixed") -> DataFrame:
    """Adds the two lines of the monitor: ``line`` and ``latency_line``."""
    at = scalars.seconds_text(F.col("event_time"), style)
    waited = scalars.seconds_text(F.col("latency"), style)
    return df.withColumns(
        {
            "line": F.format_string(
                scalars.MESSAGE_LINE, F.col("message_id"), F.col("content"), at
            ),
            "latency_line": F.format_string(scalars.LATENCY_LINE, waited),
        }
    )
