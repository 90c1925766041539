"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only in local mode where none is set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured and not current:
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskgraph-"))
        current = sc.getCheckpointDir()
    return current


#: Lets an execution remove its shuffle files as soon as it ends, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the reliable checkpoint folder; the shuffles that made it go from the disks once it is written."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        # a plan of its own: ``df`` may be run again and keeps its shuffles
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


#: Rows that a task takes of a shuffle, about: more rows make more tasks, not larger ones.
ROWS_A_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many rows, the configured ones at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


#: Bytes of an Arrow batch between the JVM and a Python worker, about; each side holds two or three at a time.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes, unless the session has a bound of its own: Spark's 64 MB are several buffers of
    that size outside the heap, and again in each Python worker, which are kept for later steps."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def packaged(spark: SparkSession) -> None:
    """Ship this package to executors that don't have it installed (``--py-files`` does the same)."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="riskgraph-package-"), "riskgraph")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "riskgraph"))
