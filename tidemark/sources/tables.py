"""Tables by name: the driver's Parquet files as frames and as views for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """A SELECT over views of the tables that it names."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", query):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(query)
