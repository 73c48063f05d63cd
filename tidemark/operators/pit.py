"""Point-in-time data: when a value became public, and joins that cannot see the future."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendars


def release_date(period: Column, weekday: str, calendar: str = "us_federal") -> Column:
    """The first such weekday strictly after the period, later by one business day for each holiday of its week up to it."""
    nominal = F.next_day(period, weekday)
    holidays = F.size(calendars.holidays_between(F.date_sub(nominal, F.weekday(nominal)), nominal, calendar))
    return F.when(holidays > 0, calendars.ahead(nominal, F.greatest(holidays, F.lit(1)), calendar)).otherwise(nominal)


def release_dates(rows: DataFrame, period: str, weekday: str, calendar: str = "us_federal") -> DataFrame:
    """rows with release_date; null for a null period."""
    return calendars.looked_up(rows, [period], "release_date", release_date(F.col(period), weekday, calendar))


def utc(date: Column, clock: str, zone: str) -> Column:
    """A local date and clock time as a UTC timestamp without zone."""
    return F.to_utc_timestamp(F.concat(date.cast("string"), F.lit(f" {clock}")).cast("timestamp_ntz"), zone).cast("timestamp_ntz")


def next_day_availability(published: Column, lag_days: int, zone: str) -> Column:
    return utc(F.date_add(published, lag_days), "00:00:00", zone)


def apply_overrides(rows: DataFrame, overrides: Sequence[tuple[dt.date, dt.date, dt.datetime]], period: str = "period", available: str = "available_at") -> DataFrame:
    """Rows whose period lies in a configured range (first, last, late) are public no earlier than late; each row by itself."""
    out = F.col(available)
    for first, last, late in overrides:
        inside = F.col(period).between(F.lit(first), F.lit(last)) & F.col(available).isNotNull()
        out = F.when(inside, F.greatest(out, F.lit(late).cast("timestamp_ntz"))).otherwise(out)
    return rows.withColumn(available, out)


#: Days of one bucket of time, and how many halvings reach from all buckets down to one.
BUCKET_DAYS, LEVELS = 32, 18


def _same(keys: Sequence[str], other: str = "_r_") -> Column:
    """Keys that agree, null with null; the right side has them under other names."""
    return reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"{other}{k}")), keys, F.lit(True))


def _nearest(left: DataFrame, right: DataFrame, by: Sequence[str], tie: str | None, greatest: bool = False, forward: bool = False, strict: bool = False) -> DataFrame:
    """left (by, _t, _left) with _found, the best _v of right (by, _t, _v) up to its time, or from it on if forward.

    Time is cut into buckets, so no key is ever sorted in one task. Within a
    bucket a window answers. What all earlier buckets have comes from sums over
    dyadic runs of buckets: a bucket adds to LEVELS of them, and everything
    before a bucket is at most LEVELS of them again, which meet by equal keys.
    Best is the last by time and tie, or the greatest tie.
    """
    kind = dict(left.dtypes)["_t"]
    days = F.unix_date(F.col("_t").cast("date")) if kind == "date" or kind.startswith("timestamp") else F.col("_t")  # positions count as days
    bucket = (F.floor((-days if forward else days) / BUCKET_DAYS) + (1 << (LEVELS - 1))).cast("long")
    pick = F.min_by if forward else F.max_by
    order = F.struct(F.col(f"_x._v.{tie}")) if greatest else F.struct("_x._t", *([F.col(f"_x._v.{tie}")] if tie else []))
    a = left.withColumn("_b", bucket)
    b = right.filter("_t is not null").withColumn("_b", bucket).select(*by, "_t", "_b", F.struct("_t", "_v").alias("_x"))
    halved = lambda frame: frame.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("_n", F.expr("shiftright(_b, _l)"))
    sums = halved(b.groupBy(*by, "_b").agg(pick("_x", order).alias("_x"))).groupBy(*by, "_l", "_n").agg(pick("_x", order).alias("_x"))
    asked = halved(a.filter("_b is not null").select(*by, "_b").distinct()).filter("_n % 2 = 1").withColumn("_n", F.col("_n") - 1)
    keys = [*by, "_l", "_n"]
    met = asked.join(sums.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_x"), _same(keys))
    carried = met.groupBy(*by, "_b").agg(pick("_x", order).alias("_c")).select(*[F.col(k).alias(f"_r_{k}") for k in (*by, "_b")], "_c")
    nothing = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    side = F.lit(0 if strict else 1)
    both = a.select(*by, "_t", "_b", side.alias("_side"), "_left", nothing(b, "_x"), F.lit(True).alias("_own")).unionByName(
        b.select(*by, "_t", "_b", (1 - side).alias("_side"), nothing(a, "_left"), "_x", F.lit(False).alias("_own"))
    )
    along = [F.col("_t").desc() if forward else F.col("_t"), F.col("_side"), *([F.col(f"_x._v.{tie}").asc_nulls_first()] if tie else [])]
    frame = Window.partitionBy(*by, "_b").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    found = (F.max_by("_x", order) if greatest else F.last("_x", ignorenulls=True)).over(frame)
    own = both.withColumn("_f", found).filter("_own").join(carried, _same([*by, "_b"]), "left")
    best = F.coalesce("_f", "_c")
    if greatest:
        best = F.when(F.coalesce(F.col(f"_c._v.{tie}") > F.col(f"_f._v.{tie}"), F.lit(False)), F.col("_c")).otherwise(best)
    return own.select("_left", best["_v"].alias("_found"))


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str], by: tuple[str, ...] = (), tie: str | None = None, order_by: str = "release") -> DataFrame:
    """Each left row with the values of the last right row whose time is not after its own.

    order_by 'release' takes the latest time, ties by the greatest tie column;
    'period' takes the greatest tie column among all that are public. Rows
    never multiply, null keys meet null keys, and a null time finds nothing.
    """
    packed = F.struct(*[F.col(c) for c in dict.fromkeys([*([tie] if tie else []), *values])])
    a = left.select(*by, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_left"))
    b = right.select(*by, F.col(right_time).alias("_t"), packed.alias("_v"))
    met = _nearest(a, b, by, tie, greatest=order_by == "period")
    return met.select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def next_after(left: DataFrame, dates: DataFrame, left_date: str, right_date: str, out: str, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Each left row with the first date on or after its own (or only after)."""
    a = left.select(*by, F.col(left_date).alias("_t"), F.struct(*left.columns).alias("_left"))
    b = dates.select(*by, F.col(right_date).alias("_t"), F.struct(F.col(right_date).alias("date")).alias("_v"))
    met = _nearest(a, b, by, None, forward=True, strict=strict)
    return met.select("_left.*", F.col("_found.date").alias(out))
