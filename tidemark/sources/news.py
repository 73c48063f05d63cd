"""Vintages of news feeds: what was seen when, kept for good and merged without doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "feed string, title string, link string, published timestamp, source string"
LOOKBACK_DAYS = 14


def merged(seen: DataFrame, batch: DataFrame, arrived: Column, at: str = "first_seen") -> DataFrame:
    """seen (ITEM, first_seen, revisions) with the items of a batch.

    A title is an item of its feed. It keeps the moment it was first seen, and
    takes link, source and time from the latest arrival that changes them;
    `revisions` counts those. The same batch again changes nothing.
    """
    key, rest = ["feed", "title"], ["link", "published", "source"]
    order = Window.partitionBy(*key).orderBy(F.col("published").desc_nulls_last(), "link", "source")
    new = batch.filter("title is not null").select(*key, *rest).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    new = new.select(*key, F.struct(*rest).alias("_new"), arrived.alias("_at"))
    old = seen.select(*key, F.struct(*rest).alias("_old"), F.col(at).alias("_first"), "revisions")
    met = old.join(new, key, "full")
    known, changed = F.col("_old").isNotNull(), F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    item = F.when(changed, F.col("_new")).otherwise(F.col("_old"))
    later = known & changed & (F.col("_at") > F.col("_first"))
    return met.select(
        *key, *[F.when(known & ~later, F.col("_old")[c]).otherwise(item[c]).alias(c) for c in rest],
        F.when(known, F.col("_first")).otherwise(F.col("_at")).alias(at), (F.coalesce("revisions", F.lit(0)) + later.cast("int")).alias("revisions"),
    )


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"{ITEM}, first_seen timestamp, revisions int")


def headlines(seen: DataFrame, now: Column, days: int = LOOKBACK_DAYS) -> DataFrame:
    """One row a title of what was seen by now and published in the last days, newest first; of equal titles the one seen first stays."""
    recent = seen.filter((F.col("first_seen") <= now) & (F.col("published") >= now - F.make_dt_interval(days=F.lit(days))))
    order = Window.partitionBy("title").orderBy("first_seen", "feed")
    kept = recent.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return kept.orderBy(F.col("published").desc(), "title")


def stale(seen: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """(feed, age_hours, stale) by the last arrival of each feed."""
    last = seen.groupBy("feed").agg(F.max("first_seen").alias("at"))
    age = (F.unix_micros(now) - F.unix_micros("at")) / 3.6e9
    return last.select("feed", age.alias("age_hours"), (age > ttl_hours).alias("stale"))
