"""What a consumer group has read of a table topic: committed offsets and progress.

A broker keeps the offsets of its groups; a table has nobody to do so. Here the
query itself observes, for every batch, the highest offset that it read of each
partition, before any record is dropped. Once a batch is committed, the ends are
kept beside the group's checkpoint, together with a tick: when, and how many records.

Two places are written in turn, each with everything that is known, so that one is
whole at any time and nothing grows with the number of batches but the ticks, of
which the newest are kept. If the driver is lost between the commit of a batch and
its note, the ends are those of the batch before until the next one is noted: a lag
may be too large for that time, never too small.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallyline.session import checkpoint_path
from tallyline.sources.spec import TopicSpec

OBSERVED = "offsets"
TICKS = 10_000  # newest ticks that are kept of a group's job

_SCHEMA = "kind string, batch bigint, number bigint, value bigint, at string"
_END, _TICK, _WHOLE = "end", "tick", "whole"
_logs: dict[str, "ProgressLog"] = {}


def observe_offsets(df: DataFrame, partitions: int) -> DataFrame:
    """Has a continuing read report what it read of each partition of its topic."""
    place = F.col("partition")
    ends = [
        F.max(F.when(place == p, F.col("offset") + 1)).alias(f"p{p}") for p in range(partitions)
    ]
    stray = F.count_if(~place.between(0, partitions - 1)).alias("stray")
    return df.observe(OBSERVED, F.count(F.lit(1)).alias("n"), stray, *ends)


def never_written(problem: AnalysisException) -> None:
    """Lets a missing table pass, as one that nothing was written to yet."""
    if problem.getCondition() != "PATH_NOT_FOUND":
        raise problem


def _place(spark: SparkSession, group: str, job: str) -> str:
    return f"{checkpoint_path(spark, group, job)}/offsets"


def _kept(spark: SparkSession, place: str) -> tuple[list, int]:
    """The rows of the newer of the two notes that is whole, and where it is."""
    best, newest, found = [], None, 1
    for slot in (0, 1):
        try:
            rows = spark.read.schema(_SCHEMA).json(f"{place}/slot={slot}").collect()
        except AnalysisException as problem:
            never_written(problem)
            continue
        whole = [row["batch"] for row in rows if row["kind"] == _WHOLE]
        if whole and (newest is None or whole[0] > newest):
            best, newest, found = rows, whole[0], slot
    return best, found


class ProgressLog(StreamingQueryListener):
    """Keeps the ends and ticks of one group's job while its query runs. On the driver
    it holds a number per partition and the newest ticks."""

    def __init__(self, spark: SparkSession, group: str, job: str):
        self.spark, self.name = spark, f"{group}.{job}"
        self.place = _place(spark, group, job)
        rows, self.slot = _kept(spark, self.place)
        self.ends = {row["number"]: row["value"] for row in rows if row["kind"] == _END}
        ticks = [(r["batch"], r["value"], r["at"]) for r in rows if r["kind"] == _TICK]
        self.ticks = deque(sorted(ticks), maxlen=TICKS)
        self.query, self.fault, self.lock = None, None, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self._see(event.progress)

    def _see(self, progress) -> None:
        seen = progress.observedMetrics.get(OBSERVED)
        if seen is None or not seen["n"]:
            return
        with self.lock:
            try:
                self._note(progress.batchId, progress.timestamp, seen.asDict())
            except Exception as problem:  # a listener's faults would go unseen
                self.fault = problem

    def _note(self, batch: int, at: str, seen: dict) -> None:
        if seen["stray"]:
            raise ValueError(f"{self.name} reads partitions beyond those its topic declares")
        if self.ticks and self.ticks[-1][0] >= batch:
            return
        for name, end in seen.items():
            if name.startswith("p") and end is not None:
                place = int(name[1:])
                self.ends[place] = max(end, self.ends.get(place, 0))
        self.ticks.append((batch, seen["n"], at))
        rows = [(_END, batch, p, end, at) for p, end in self.ends.items()]
        rows += [(_TICK, b, 0, n, t) for b, n, t in self.ticks]
        rows.append((_WHOLE, batch, 0, 0, at))
        noted = self.spark.createDataFrame(rows, _SCHEMA).coalesce(1)
        self.slot = 1 - self.slot
        noted.write.mode("overwrite").json(f"{self.place}/slot={self.slot}")

    def settle(self) -> None:
        """Notes what a query that has ended still knows of its last batches, so that
        nobody waits for the listener, which is told of them some time later."""
        if self.query is not None and self.query.isActive:
            return
        if self.query is not None:
            for progress in self.query.recentProgress:
                self._see(progress)
        self.spark.streams.removeListener(self)
        if self.fault is not None:
            raise self.fault


def follow(spark: SparkSession, group: str, job: str, start: Callable[[], StreamingQuery]):
    """Starts the query of a group's job, and notes its progress from then on."""
    settle(spark, group, job)
    log = ProgressLog(spark, group, job)
    spark.streams.addListener(log)
    _logs[log.place] = log
    log.query = start()
    return log.query


def settle(spark: SparkSession, group: str, job: str) -> None:
    log = _logs.get(_place(spark, group, job))
    if log is not None and log.spark is spark:
        log.settle()


def committed_offsets(
    spark: SparkSession, spec: TopicSpec, job: str, first: dict[int, int] | None = None
) -> DataFrame:
    """``group``, ``topic``, ``partition`` and ``committed`` of a group that reads a table
    topic: one past the last record read of each partition, dropped ones included. A
    partition that was not read counts from where the group began, if that is named in
    ``first``; else it has no row, like a group at a broker that committed nothing."""
    settle(spark, spec.group, job)
    ends = dict(first or {})
    for row in _kept(spark, _place(spark, spec.group, job))[0]:
        if row["kind"] == _END:
            ends[row["number"]] = max(row["value"], ends.get(row["number"], 0))
    rows = [(spec.group, spec.topic, p, end) for p, end in sorted(ends.items())]
    return spark.createDataFrame(
        rows, "group string, topic string, partition int, committed bigint"
    )


def progress_ticks(spark: SparkSession, spec: TopicSpec, job: str) -> DataFrame:
    """``tick`` and ``n``: when each batch of a group's job was begun, and its records."""
    settle(spark, spec.group, job)
    rows = _kept(spark, _place(spark, spec.group, job))[0]
    ticks = [(r["batch"], r["at"], r["value"]) for r in rows if r["kind"] == _TICK]
    found = spark.createDataFrame(ticks, "batch bigint, at string, n bigint")
    return found.select("batch", F.to_timestamp("at").alias("tick"), "n")
