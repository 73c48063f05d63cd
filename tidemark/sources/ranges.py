"""Date ranges of cached series: what is held, what is missing, and what must be fetched again.

Everything works on tables of many series at once. Ranges are inclusive dates;
a null end makes a range that holds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a stale series is fetched again from this many days before its last row, so that corrections land.
TAIL_DAYS = 7


def merged(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, first, last) of ranges as the fewest that hold the same days: those that overlap or touch become one."""
    known = ranges.filter("first <= last").select(*keys, "first", "last").distinct()
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > F.date_add(reach, 1), F.lit(True))
    numbered = known.withColumn("_new", begins.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def missing(wanted: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, first, last): the days of wanted that no range of held covers, as ranges."""
    asked, there = merged(wanted, keys), merged(held, keys)
    met = asked.join(there.select(*keys, F.col("first").alias("_a"), F.col("last").alias("_b")), list(keys), "left")
    # a held range outside the wanted one says nothing about it
    inside = F.when((F.col("_b") >= F.col("first")) & (F.col("_a") <= F.col("last")), F.struct("_a", "_b"))
    packed = met.groupBy(*keys, "first", "last").agg(F.array_sort(F.collect_list(inside)).alias("_h"))
    ends = F.concat(F.array(F.date_sub("first", 1)), F.transform("_h", lambda h: h["_b"]))
    starts = F.concat(F.transform("_h", lambda h: h["_a"]), F.array(F.date_add("last", 1)))
    gaps = F.zip_with(ends, starts, lambda b, a: F.struct(F.date_add(b, 1).alias("first"), F.date_sub(a, 1).alias("last")))
    return packed.select(*keys, F.inline(F.filter(gaps, lambda g: g["first"] <= g["last"])))


def age_hours(fetched_at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched_at.cast("timestamp"))) / 3.6e9


def to_fetch(requests: DataFrame, coverage: DataFrame, keys: Sequence[str] = ("provider", "key"), tail_days: int = TAIL_DAYS) -> DataFrame:
    """(keys, source, stale, parts) of requests (keys, start, end, now, ttl_hours, refresh) against coverage (keys, coverage_start, last_row, fetched_at).

    parts are the ranges to fetch as (part, first, last): `all` for a series
    that is not held, or is to be refreshed; `head` before what is covered;
    `tail` from some days before the last row, where the series is older than
    its time to live and the request reaches its last row. source is network,
    cache+network or cache.
    """
    held = requests.join(coverage.withColumn("_held", F.lit(True)), list(keys), "left")
    cached = F.coalesce(F.col("_held"), F.lit(False)) & ~F.col("refresh")
    stale = age_hours(F.col("fetched_at"), F.col("now")) > F.col("ttl_hours")
    start, last = F.col("coverage_start"), F.col("last_row")
    part = lambda name, a, b: F.struct(F.lit(name).alias("part"), a.alias("first"), b.alias("last"))
    head = F.when(start.isNull() | (F.col("start") < start), part("head", F.col("start"), F.date_sub(F.coalesce(start, F.col("end")), 1)))
    begun = F.when(start.isNull(), F.col("start")).otherwise(F.least("start", start))  # covered once the head is there
    tail = F.when(stale & (last.isNull() | (F.col("end") >= last)), part("tail", F.coalesce(F.date_sub(last, tail_days), begun), F.col("end")))
    parts = F.when(cached, F.array_compact(F.array(head, tail))).otherwise(F.array(part("all", F.col("start"), F.col("end"))))
    out = held.withColumn("parts", F.filter(parts, lambda p: p["first"] <= p["last"]))
    source = F.when(~cached, "network").when(F.size("parts") > 0, "cache+network").otherwise("cache")
    return out.select(*keys, source.alias("source"), (cached & F.coalesce(stale, F.lit(False))).alias("stale"), "parts")
