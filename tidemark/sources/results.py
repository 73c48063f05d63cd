"""Results stored under the key of what they were computed from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.content import content_key


def cached(spark: SparkSession, root: str, name: str, inputs: dict[str, DataFrame], config: object, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The result of compute for these inputs and this configuration, read where it is stored.

    A stored result is whole: Spark marks its folder once all tasks are done.
    Of two that compute the same, the one that comes second reads the other's.
    """
    path = f"{root.rstrip('/')}/{name}/{content_key(inputs, config)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if refresh or not whole:
        try:
            compute().write.mode("overwrite" if refresh or files.exists(at) else "errorifexists").parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    return spark.read.parquet(path)
