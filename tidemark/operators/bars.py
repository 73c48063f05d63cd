"""Daily bars and weekly series out of transaction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_bars(rows: DataFrame, symbol: Column, time: Column, price: Column, tie: Column) -> DataFrame:
    """(symbol, date, open, high, low, close, volume): first and last price by the tie-breaking key of a day."""
    keyed = rows.select(symbol.alias("symbol"), F.to_date(time).alias("date"), price.cast("double").alias("p"), tie.alias("k"))
    return keyed.groupBy("symbol", "date").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )


def weekly_sum(rows: DataFrame, time: Column, value: Column, *keys: Column) -> DataFrame:
    """(keys, period, value): sums over weeks from Monday, dated on their Friday."""
    period = F.date_add(F.to_date(F.date_trunc("week", time)), 4)
    return rows.groupBy(*keys, period.alias("period")).agg(F.sum(value).alias("value"))


def keep_last(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """One row a key: the first in the given order, which must be unique within a key."""
    best = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return rows.select(best.alias("row"), at.alias("at")).filter("at = 1").select("row.*")


def merge_range(old: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """A cached range with its refetched tail: rows of the newer fetch win."""
    both = old.withColumn("_fetch", F.lit(0)).unionByName(new.withColumn("_fetch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, [key], F.col("_fetch").desc()).drop("_fetch")
