"""Services over stored tables: prices with rolls and quality, series with their release times, curves, and what was public at a decision.

Instruments are a table (symbol, exchange, roll_rule, contract_root, market_code),
one row each; a symbol that is not in it is one without rolls.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.written import Written

from . import calendars, fundamentals, pit, quality, rolls

RULES = ("cl", "ng", "ttf", "last_bd", "brent")
#: The exchange of symbols outside the configured ones, and the Atlantic hurricane season.
ADHOC_EXCHANGE = "NYSE Arca"
HURRICANE_SEASON = ((6, 1), (11, 30))


class Schedule(NamedTuple):
    """When a weekly report on a period is published, on the calendar of its publisher."""

    weekday: str
    clock: str
    zone: str = "America/New_York"
    calendar: str = "us_federal"


class Prices(NamedTuple):
    frame: DataFrame
    rolls: DataFrame
    issues: DataFrame


def instruments_of(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """The instrument of each symbol; others trade on ADHOC_EXCHANGE and never roll."""
    held = symbols.select("symbol").distinct().join(instruments, "symbol", "left")
    return held.withColumn("exchange", F.coalesce("exchange", F.lit(ADHOC_EXCHANGE))).withColumn("roll_rule", F.coalesce("roll_rule", F.lit("none")))


def roll_windows(bars: DataFrame, instruments: DataFrame, before: int = rolls.BEFORE, after: int = rolls.AFTER) -> DataFrame:
    """(symbol, expiry, start, end) of every contract that expires while a symbol has bars, and of the next one."""
    edge = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last")).join(instruments.select("symbol", "roll_rule"), "symbol")
    months = F.sequence(F.trunc("first", "month"), F.add_months(F.col("last"), 3), F.expr("interval 1 month"))
    rows = edge.filter(F.col("roll_rule").isin(*RULES)).select("symbol", "roll_rule", "first", "last", F.explode(months).alias("delivery"))
    expiry = F.lit(None).cast("date")
    for rule in RULES:
        expiry = F.when(F.col("roll_rule") == rule, calendars.expiry(F.col("delivery"), rule)).otherwise(expiry)
    rows = rows.withColumn("expiry", F.explode(F.array(expiry)))  # a generator, so that the rules are worked out once and not in the filter again
    rows = rows.filter((F.col("expiry") >= F.col("first")) & (F.col("expiry") <= F.date_add("last", 31)))
    exchange = F.when(F.col("roll_rule").isin("brent", "ttf"), "uk").otherwise("cme")
    ends = rows.select("symbol", "expiry", exchange.alias("_x")).distinct()  # a shuffle between them keeps the rules from being worked out again
    moved = lambda f, n: F.when(F.col("_x") == "uk", f(F.col("expiry"), n, "uk")).otherwise(f(F.col("expiry"), n))
    return ends.select("symbol", "expiry", moved(calendars.behind, before).alias("start"), moved(calendars.ahead, after).alias("end"))


def roll_adjust(bars: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with masked returns and carried-back levels, and the rolls they come from."""
    found = rolls.detect_rolls(bars, windows)
    return rolls.adjusted(rolls.masked_returns(bars, found)), found


def feature_returns(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """bars with ret, null inside roll windows, and in_window: known at the time, as windows follow from the calendar alone."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    raw = F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before))
    return rolls.in_windows(bars.withColumn("_raw", raw), windows).withColumn("ret", F.when(~F.col("in_window"), F.col("_raw"))).drop("_raw")


def prices(bars: DataFrame, instruments: DataFrame, as_of: dt.date | None = None, calendar: str | None = None) -> Prices:
    """Bars up to as_of with masked returns, their rolls and the issues found, each symbol by the calendar of its exchange.

    Later bars are dropped before anything is detected, so nothing here can see
    them. A symbol that has none left is an `empty` issue, an error. A calendar
    that is given holds for all symbols.
    """
    seen = bars if as_of is None else bars.filter(F.col("date") <= F.lit(as_of))
    listed = instruments_of(bars, instruments).withColumn("calendar", calendars.calendar_for(F.col("exchange")) if calendar is None else F.lit(calendar))
    written = Written(bars.sparkSession, "prices")
    frame, found = roll_adjust(seen, written.save(roll_windows(seen, listed), "windows"))  # a few rows a symbol and year, read by all three
    frame, found = written.save(frame, "frame"), written.save(found, "rolls")
    today, returns = F.lit(as_of) if as_of else F.current_date(), frame.select("symbol", "date", "ret")
    issues = quality.report(seen, returns, today, calendar or "cme", listed.select("symbol", "calendar"))
    return Prices(frame, found, issues.unionByName(quality.rolls(found)).unionByName(quality.empty(bars, seen)))


def weekly_series(rows: DataFrame, schedule: Schedule, overrides: Sequence[tuple[dt.date, dt.date, dt.date]] = (), period: str = "period") -> DataFrame:
    """rows of a weekly report with available_at from its schedule; overrides (first, last, public from) only ever delay."""
    dated = pit.release_dates(rows, period, schedule.weekday, schedule.calendar)
    dated = dated.withColumn("available_at", pit.utc(F.col("release_date"), schedule.clock, schedule.zone)).drop("release_date")
    for first, last, late in overrides:
        stamp = pit.utc(F.lit(late), schedule.clock, schedule.zone)
        dated = dated.withColumn("available_at", F.when(F.col(period).between(F.lit(first), F.lit(last)), F.greatest("available_at", stamp)).otherwise(F.col("available_at")))
    return dated


def first_releases(rows: DataFrame, lag_days: int = 1, zone: str = "America/New_York") -> DataFrame:
    """rows (series, date, value, realtime_start) with the first published value of each date and when it was public."""
    first = rows.groupBy("series", "date").agg(F.min_by("value", "realtime_start").alias("value"), F.min("realtime_start").alias("first_published"))
    return first.withColumn("available_at", pit.next_day_availability(F.col("first_published"), lag_days, zone))


def positions_at(reports: DataFrame, decisions: DataFrame, weeks: int = 156, least: int = 78, late: int = 26) -> DataFrame:
    """One row a decision (symbol, t) with public reports: the last one's net position, share, weekly change, percentile and commercial net.

    Change and percentile of a report are worked out once, over those before it
    that were public when it was; a report that comes out later than a newer one
    adds a version of each that it changes, from its own release on. Up to
    `late` reports may be overdue at once. Then an as-of join: nothing is
    repeated for each decision. A report of null numbers counts as the last,
    with null results.
    """
    commercial = F.col("commercial_long") - F.col("commercial_short") if "commercial_long" in reports.columns else F.lit(None).cast("double")
    net = F.col("long") - F.col("short")
    rows = reports.withColumns({"net": net, "share": F.try_divide(net, F.col("open_interest")), "commercial_net": commercial, "own": F.col("available_at")})
    frame = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - weeks - late, 0)
    held = rows.withColumn("before", F.collect_list(F.struct("available_at", "net")).over(frame)).filter("own is not null")
    times = F.array_distinct(F.transform(F.filter("before", lambda b: b.available_at >= F.col("own")), lambda b: b.available_at))
    versions = held.withColumn("available_at", F.explode(times))
    public = versions.withColumn("before", F.filter("before", lambda b: b.available_at <= F.col("available_at")))
    values = F.filter(F.transform(F.slice("before", F.greatest(F.size("before") - weeks + 1, F.lit(1)), weeks), lambda b: b.net), lambda x: x.isNotNull())
    ranked = public.withColumn("values", values).withColumn("last", F.try_element_at("values", F.lit(-1)))
    below, same = F.size(F.filter("values", lambda x: x < F.col("last"))), F.size(F.filter("values", lambda x: x == F.col("last")))
    rank = 100.0 * (below + 0.5 * (same - 1)) / F.greatest(F.size("values") - 1, F.lit(1))
    fields = F.struct(
        F.col("date").alias("report_date"), F.col("own").alias("released_at"), "net", "share", (F.col("net") - F.try_element_at("before", F.lit(-2)).net).alias("change"),
        F.when(F.size("values") >= least, rank).alias("pctile"), "commercial_net",
    )
    ready = ranked.select("symbol", "available_at", F.struct("date", "available_at").alias("version"), fields.alias("positions"))
    found = pit.as_of_join(decisions.select("symbol", "t"), ready, "t", "available_at", ["positions"], by=("symbol",), tie="version", order_by="period")
    return found.filter("positions is not null")


def crack_at(bars: DataFrame, as_of: Column, window: int = 252) -> DataFrame:
    """(date, value, pctile_1y, roll_affected) of the 3-2-1 spread of bars (symbol cl, rb, ho; reason) at the last common date up to as_of."""
    seen = bars.filter(F.col("date") <= as_of)
    pick = lambda c, x: F.max(F.when(F.col("symbol") == c, F.col(x)))
    legs = seen.groupBy("date").agg(*[pick(c, "close").alias(c) for c in ("cl", "rb", "ho")])
    spread = fundamentals.spread_321(legs).select(F.lit("crack").alias("symbol"), "date", F.col("spread").alias("x"))
    last = spread.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("x", "date").alias("value"))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))
    rolling = seen.withColumn("_back", back).filter("_back <= 2").agg(F.coalesce(F.bool_or(F.col("reason") == "roll"), F.lit(False)).alias("roll_affected"))
    return last.join(fundamentals.percentile_last(spread, window), "symbol").join(rolling).select("date", "value", F.col("pctile").alias("pctile_1y"), "roll_affected")


def curve_at(curve: DataFrame) -> DataFrame:
    """(symbol, contracts, metrics) of curve (symbol, expiry, settle); none with fewer than two contracts."""
    listed = curve.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("expiry", "settle"))).alias("contracts"))  # a few contracts a symbol
    metrics = fundamentals.curve_metrics(curve)
    packed = metrics.select("symbol", F.struct(*[c for c in metrics.columns if c != "symbol"]).alias("metrics"))
    return listed.filter(F.size("contracts") >= 2).join(packed, "symbol")


def macro_last(series: DataFrame, as_of: Column, steps: int = 20) -> DataFrame:
    """(series, last_date, last, change_20_obs) of the values public at as_of."""
    seen = series.filter((F.col("available_at") <= as_of) & F.col("value").isNotNull())
    back = seen.withColumn("back", F.row_number().over(Window.partitionBy("series").orderBy(F.col("date").desc()))).filter(F.col("back") <= steps + 1)
    at = lambda k, c: F.max(F.when(F.col("back") == k, F.col(c)))
    return back.groupBy("series").agg(at(1, "date").alias("last_date"), at(1, "value").alias("last"), (at(1, "value") - at(steps + 1, "value")).alias("change_20_obs"))


def event_calendar(dates: DataFrame, reports: dict[str, tuple[str, Schedule]], as_of: str = "as_of") -> DataFrame:
    """(as_of, date, event) of the next release of each report (label: weekday of its periods, schedule) on or after each date."""
    at, events = F.col(as_of), []
    for label, (weekday, schedule) in reports.items():
        last = F.next_day(F.date_sub(at, 7), weekday)  # the last such weekday up to the date
        this, later = (pit.release_date(p, schedule.weekday, schedule.calendar) for p in (last, F.date_add(last, 7)))
        events.append(F.struct(F.when(this >= at, this).otherwise(later).alias("date"), F.lit(label).alias("event")))
    return dates.select(as_of, F.inline(F.array(*events)))


def next_expiry(date: Column, rule: str, months: int = 4) -> Column:
    """The next last trading day on or after a date."""
    later = F.transform(F.sequence(F.lit(0), F.lit(months)), lambda k: calendars.expiry(F.add_months(F.trunc(date, "month"), k), rule))
    return F.array_min(F.filter(later, lambda e: e >= date))


def sessions_to_roll(date: Column, rule: str) -> Column:
    """Weekdays until the next expiry; null where nothing expires."""
    return F.lit(None).cast("int") if rule == "none" else calendars.weekdays_between(date, next_expiry(date, rule)).cast("int")


def in_hurricane_season(date: Column) -> Column:
    (m1, d1), (m2, d2) = HURRICANE_SEASON
    place = F.month(date) * 100 + F.day(date)
    return place.between(m1 * 100 + d1, m2 * 100 + d2)
