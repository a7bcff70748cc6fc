"""Session helpers: where durable intermediates live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_RUNS: list[str] = []  # folders of the runs that are open, innermost last


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only in one local JVM a temporary one will do."""
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors of {master} share")
    fallback = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, visible to every executor."""
    top = _RUNS[-1] if _RUNS else shared_dir(spark).rstrip("/")
    return f"{top}/tidemark-{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A folder for all intermediates that are written inside the block; dropped at its end.

    What must outlive the block is written elsewhere. Blocks are opened one after another or inside one another.
    """
    top = scratch_path(spark, "run")
    _RUNS.append(top)
    try:
        yield top
    finally:
        _RUNS.remove(top)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    A lost executor never replays the history, and the plan really starts afresh: a checkpointed frame
    would carry its old constraints along, which grow without bound in iterative jobs. The stored table
    also has true size statistics and prunes columns.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
