"""Tables that cut the lineage of a run, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows of texts or vectors that a Python task holds at a time.
BATCH = 2048
_roots: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is made, in local mode only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="vecspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clear() -> None:
    for root in _roots:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone
            _delete(root)


class Stage:
    """The tables of one run, which a lost executor doesn't take along.

    ``drop`` deletes tables that no later step reads; the others go when the
    driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def write(self, df: DataFrame, name: str, by: str | None = None, batch: int = BATCH) -> DataFrame:
        """The table, read from its files; with ``by``, in a folder for each value of that column.

        Python tasks get ``batch`` rows at a time meanwhile, if the session gives them more.
        """
        path, key = f"{self.root}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        writer = df.write.option("compression", "zstd")
        try:
            if not 0 < int(before) <= batch:
                self.spark.conf.set(key, str(batch))
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            self.spark.conf.set(key, before)
        # Spark deletes the shuffle files of a finished job when the driver has collected the job's objects.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(f"{self.root}/{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """One table, computed once and read from its files."""
    return Stage(df.sparkSession, name).write(df, "table")
