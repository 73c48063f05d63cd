"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
PREFIX = "tidemark-"


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where none is set, as in tests on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_CHECKPOINTS}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Written:
    """Tables of one call under a folder of its own.

    A table that a returned frame still reads must outlive the call; `drop`
    removes those that nothing reads any more, `leftovers` and `clear` find and
    remove what finished calls have left.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{PREFIX}{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: its lineage ends at the files."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            at, files = _path(self.spark, self.path(name))
            files.delete(at, True)


def leftovers(spark: SparkSession, older_than_s: float = 0.0) -> list[str]:
    """The folders of earlier calls in the shared folder whose last change is that old."""
    at, files = _path(spark, shared_root(spark))
    if not files.exists(at):
        return []
    now = spark._jvm.java.lang.System.currentTimeMillis()
    found = [s for s in files.listStatus(at) if s.getPath().getName().startswith(PREFIX)]
    return sorted(s.getPath().toString() for s in found if now - s.getModificationTime() >= 1000 * older_than_s)


def clear(spark: SparkSession, older_than_s: float) -> list[str]:
    """Remove the folders of calls that ended so long ago; frames that still read them fail afterwards."""
    gone = leftovers(spark, older_than_s)
    for path in gone:
        at, files = _path(spark, path)
        files.delete(at, True)
    return gone
