"""Operational figures of a topic: rates, progress, summaries and lag.

All are partial aggregates first, so a single busy key, partition or moment
costs one row per task in the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import scalars
from tallyline.operators.layout import with_offsets

# Fixed values of the reports.
REPORT_SECONDS = 5
REPORT_ROWS = 10_000
LAG_LINE = "Group: %s | Total Lag: %d messages"
NO_END_LINE = "Group: %s | Total Lag: unknown"
NO_GROUP_LINE = "Group '%s' not found or has no offsets..."


def _elapsed(ts: str):
    first, last = F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))
    return (last - first).cast("double") / F.lit(1e6)


def throughput(
    df: DataFrame, ts: str = "timestamp", seconds: int = REPORT_SECONDS, by: tuple[str, ...] = ()
) -> DataFrame:
    """Records per tumbling window: the count, the whole number per second and
    the exact rate. Windows without records do not appear. On a stream, put
    ``withWatermark`` before it to have windows closed and emitted."""
    counts = df.groupBy(F.window(ts, f"{seconds} seconds"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.col("window.start").alias("window_start"),
        *by,
        "n",
        scalars.per_second(F.col("n"), seconds).alias("per_sec"),
        (F.col("n") / F.lit(float(seconds))).alias("rate"),
    )


def throughput_by(
    df: DataFrame,
    by: str,
    ts: str = "timestamp",
    window: str | None = None,
    min_rows: int = REPORT_ROWS,
    min_seconds: float = REPORT_SECONDS,
) -> DataFrame:
    """Records per second of each worker over the time it was seen; reported from
    ``min_rows`` and ``min_seconds`` on. With ``window`` a worker reports at the end
    of a window; if it has not reached both limits, its records are carried on into
    its next window, and the report has the start of the first."""
    rate = F.floor(F.try_divide("n", "seconds")).cast("bigint")
    enough = (F.col("n") >= min_rows) & (F.col("seconds") >= min_seconds)
    if window is None:
        seen = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), _elapsed(ts).alias("seconds"))
        return seen.where(enough).withColumn("per_sec", rate)
    counts = df.groupBy(by, F.window(ts, window)["start"].alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"),
        F.unix_micros(F.min(ts)).alias("low"),
        F.unix_micros(F.max(ts)).alias("high"),
    )
    found = _carried(_segments(counts, by, min_rows, min_seconds), by, min_rows, min_seconds)
    seconds = ((F.col("high") - F.col("low")).cast("double") / F.lit(1e6)).alias("seconds")
    return found.select(by, "window_start", "n", seconds).withColumn("per_sec", rate)


def _segments(counts: DataFrame, by: str, min_rows: int, min_seconds: float) -> DataFrame:
    """Adds ``segment`` to the windows of each worker. A window that reaches both limits
    by itself also ends whatever was carried into it, so the next one starts anew: the
    windows up to such a one can be folded apart from all others. A segment is named by
    the end of the one before.

    That end is found on two levels, days and windows within a day, so no task sorts
    more than the windows of one day."""
    ends = (F.col("n") >= min_rows) & (F.col("high") - F.col("low") >= min_seconds * 1e6)
    windows = counts.withColumn("_day", F.date_trunc("day", "window_start"))
    end = F.when(ends, F.col("window_start"))
    before = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = windows.groupBy(by, "_day").agg(F.max(end).alias("_end"))
    days = days.select(
        F.col(by).alias("_by"), F.col("_day").alias("_d"), F.max("_end").over(before).alias("_last")
    )
    within = Window.partitionBy(by, "_day").orderBy("window_start")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    windows = windows.withColumn("_here", F.max(end).over(within))
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_day") == F.col("_d"))
    joined = windows.join(days, same, "left").withColumn("segment", F.coalesce("_here", "_last"))
    return joined.select(by, "segment", "window_start", "n", "low", "high")


def _carried(segments: DataFrame, by: str, min_rows: int, min_seconds: float) -> DataFrame:
    """The reports of each segment: windows in order, those below a limit carried on
    into the next. A task holds one carried window, however long a segment is."""

    def fold(batches):
        key, carried = None, None
        for batch in batches:
            rows, out = batch.to_pydict(), []
            owners = zip(rows[by], rows["_segment"], strict=True)
            facts = zip(rows["_start"], rows["n"], rows["low"], rows["high"], strict=True)
            for place, (owner, (start, n, low, high)) in enumerate(zip(owners, facts, strict=True)):
                if owner != key:
                    key, carried = owner, None
                if carried is not None:
                    start, n, low = carried[0], carried[1] + n, carried[2]
                carried = (start, n, low)
                if n >= min_rows and high - low >= min_seconds * 1e6:
                    out.append((place, start, n, low, high))
                    carried = None
            places, *columns = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(by).take(pa.array(places, pa.int32())),
                    *(pa.array(column, pa.int64()) for column in columns),
                ],
                names=[by, "_start", "n", "low", "high"],
            )

    rows = segments.select(
        by,
        F.unix_micros("segment").alias("_segment"),
        F.unix_micros("window_start").alias("_start"),
        "n", "low", "high",
    )
    dealt = rows.repartition(by, "_segment").sortWithinPartitions(by, "_segment", "_start")
    schema = T.StructType([segments.schema[by]])
    for name in ("_start", "n", "low", "high"):
        schema = schema.add(name, T.LongType())
    found = dealt.mapInArrow(fold, schema)
    return found.withColumn("window_start", F.timestamp_micros("_start")).drop("_start")


def throughput_per_rows(
    df: DataFrame, rows: int = REPORT_ROWS, ts: str = "timestamp"
) -> DataFrame:
    """A report after every ``rows`` records of a partition, in the order of
    offsets, which may have gaps."""
    numbered = with_offsets(df.withColumn("_given", F.col("offset")), order="_given")
    report = F.call_function("div", F.col("offset"), F.lit(rows)).alias("report")
    return (
        numbered.groupBy("partition", report)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("_given").alias("last_offset"),
            _elapsed(ts).alias("seconds"),
        )
        .where(F.col("n") == rows)
    )


def progress(
    df: DataFrame, total: int | None = None, ts: str = "timestamp", tick: str = "1 second"
) -> DataFrame:
    """Records done and whole percent after every tick that had records.

    The running total has two levels, days and ticks within a day, so no task
    holds more than the ticks of one day.
    """
    ticks = df.groupBy(F.window(ts, tick)["start"].alias("tick")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ticks = ticks.withColumn("_day", F.date_trunc("day", "tick"))
    days = ticks.groupBy("_day").agg(F.sum("n").alias("_rows"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        "_day",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"),
    )
    within = Window.partitionBy("_day").orderBy("tick").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    done = F.col("_before") + F.sum("n").over(within)
    whole = F.col("_total") if total is None else F.lit(total).cast("bigint")
    return ticks.join(days, "_day", "left").select(
        "tick", done.alias("done"), scalars.percent_done(done, whole).alias("pct")
    )


def run_summary(
    df: DataFrame, ts: str = "timestamp", by: tuple[str, ...] = (), more: tuple[Column, ...] = ()
) -> DataFrame:
    """Records, seconds from first to last, and records per second; ``more``
    aggregates come from the same pass."""
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("total"), _elapsed(ts).alias("seconds"), *more)
        .withColumn("per_sec", F.try_divide("total", "seconds"))
    )


def consumer_lag(
    committed: DataFrame, ends: DataFrame, groups: DataFrame | None = None
) -> DataFrame:
    """Records each group has still to read, over all its partitions.

    ``committed`` has group, topic, partition, committed; ``ends`` has topic,
    partition, end. A lag is unknown (NULL) when the end of a partition is. With
    ``groups``, a group that has committed nothing is reported as not found. The
    kind of join is left to Spark, which sees the size of both sides.
    """
    left = scalars.remaining(F.col("end"), F.col("committed"))
    lag = (
        committed.join(ends, ["topic", "partition"], "left")
        .groupBy("group")
        .agg(F.sum(left).alias("_lag"), F.count_if(F.col("end").isNull()).alias("_unknown"))
        .select(
            "group",
            F.when(F.col("_unknown") == 0, F.col("_lag")).alias("total_lag"),
            F.lit(True).alias("found"),
        )
    )
    if groups is None:
        return lag
    return (
        groups.select("group")
        .distinct()
        .join(lag, "group", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def lag_lines(lag: DataFrame) -> DataFrame:
    known = F.format_string(LAG_LINE, F.col("group"), F.col("total_lag"))
    unknown = F.format_string(NO_GROUP_LINE, F.col("group"))
    no_end = F.format_string(NO_END_LINE, F.col("group"))
    found = F.when(F.col("total_lag").isNull(), no_end).otherwise(known)
    return lag.withColumn("line", F.when(F.col("found"), found).otherwise(unknown))


def count_rows(df: DataFrame, by: tuple[str, ...] = ("topic", "partition")) -> DataFrame:
    """Records, and records without a payload."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("null_values")
    )


def observe_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The same figures for a whole batch job, counted while it runs."""
    seen = Observation(name)
    return df.observe(seen, *_row_metrics()), seen


def observe_stream(df: DataFrame, name: str = "rows") -> DataFrame:
    """The same figures per micro-batch, in the progress of the query."""
    return df.observe(name, *_row_metrics())


def _row_metrics():
    return (
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull()).alias("null_value"),
    )
