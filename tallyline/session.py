"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Worth setting on any cluster that runs the Arrow codecs and writes topic
# tables. A batch of payloads is small, as decoding one needs several times its
# size; Python workers keep the memory of one batch for the next, in place of
# handing it back; a task keeps the files of several partitions open, so that
# it need not sort its rows first; times are stored with statistics that
# filters can use.
SETTINGS = {
    "spark.executorEnv.MALLOC_TRIM_THRESHOLD_": str(128 << 20),
    "spark.executorEnv.MALLOC_MMAP_THRESHOLD_": str(32 << 20),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# Used only where the session names no folder, on a local master.
_local_roots: dict[str, str] = {}


def local_session(cpus: int | str = "*", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the session names it."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tallyline-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place for one table in the shared folder."""
    return f"{shared_dir(spark)}/tallyline/{name}-{uuid.uuid4().hex}"


def checkpoint_path(spark: SparkSession, group: str, job: str) -> str:
    """Progress of one consumer group in one job; the same on every start."""
    return f"{shared_dir(spark)}/tallyline/groups/{group}/{job}"
