"""Exchange calendars as column expressions: holidays follow from a date by rule, so any date has its answer.

Functions of columns give business days, shifts and expiries of any date. Those
of frames work on the distinct dates of the frame and join the answers back, as
a rule is dearer than a look-up. Null dates give null.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The calendar of each exchange; others follow cme.
EXCHANGES = {"NYMEX": "cme", "ICE": "uk", "ICE Endex": "uk", "NYSE Arca": "cme"}
#: Delivery month codes of futures.
MONTH_CODES = "FGHJKMNQUVXZ"


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday by the anonymous algorithm."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    month, day = divmod(h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114, 31)
    return dt.date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month; from the end for negative n."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7 + 7 * (-n - 1))


def _nearest(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def _monday(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: 2, 6: 1}.get(day.weekday(), 0))


def holidays(calendar: str, year: int) -> set[dt.date]:
    date, good = lambda m, d: dt.date(year, m, d), easter(year) - dt.timedelta(2)
    if calendar == "uk":
        christmas = _monday(date(12, 25))
        boxing = date(12, 26) + dt.timedelta({5: 2, 6: 2, 0: 1}.get(date(12, 26).weekday(), 0))
        return {_monday(date(1, 1)), good, good + dt.timedelta(3), _nth(year, 5, 0, 1), _nth(year, 5, 0, -1), _nth(year, 8, 0, -1), christmas, boxing}
    new_year = date(1, 1) + dt.timedelta(date(1, 1).weekday() == 6)
    out = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _nth(year, 5, 0, -1), _nearest(date(7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _nearest(date(12, 25))}
    if calendar == "cme":
        return out | {new_year, good} | ({_nearest(date(6, 19))} if year >= 2022 else set())
    if calendar == "us_federal":
        return out | {_nearest(date(1, 1)), _nth(year, 10, 0, 2), _nearest(date(11, 11))} | ({_nearest(date(6, 19))} if year >= 2021 else set()) | {d for d in [_nearest(dt.date(year + 1, 1, 1))] if d.year == year}
    raise ValueError(f"unknown calendar {calendar}")


def holiday_rows(calendar: str, first: int, last: int) -> list[tuple[str, dt.date]]:
    """Holidays of some years that fall on weekdays, as plain dates."""
    return sorted({(calendar, d) for y in range(first, last + 1) for d in holidays(calendar, y) if d.weekday() < 5})


def _easter(date: Column) -> Column:
    """Easter Sunday of the year of a date, by the same algorithm."""
    div = lambda x, n: F.floor(x / n).cast("int")
    y = F.year(date)
    a, b, c = y % 19, div(y, 100), y % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    month = h + k - 7 * div(a + 11 * h + 22 * k, 451) + 114
    return F.make_date(y, div(month, 31), month % 31 + 1)


def _nth_keys(month: int, weekday: int, first: int) -> list[int]:
    """Keys (weekday, month, day) of such a weekday in the week that begins on day first."""
    return [weekday * 10_000 + month * 100 + d for d in range(first, first + 7)]


def _fixed_keys(month: int, day: int, saturday: int, sunday: int) -> list[int]:
    """Keys of a fixed date on weekdays, and of the days it moves to from a Saturday and a Sunday (0: nowhere)."""
    date = dt.date(2001, month, day)
    out = [w * 10_000 + month * 100 + day for w in range(5)]
    for weekday, move in ((5, saturday), (6, sunday)):
        if move:
            moved = date + dt.timedelta(move)
            out.append((weekday + move) % 7 * 10_000 + moved.month * 100 + moved.day)
    return out


def _keys(calendar: str) -> list[int]:
    """Keys of all holidays whose rule needs neither the year nor Easter."""
    if calendar == "uk":
        boxing = [w * 10_000 + 1226 for w in range(1, 5)] + [1 * 10_000 + 1227, 0 * 10_000 + 1228, 1 * 10_000 + 1228]
        return _fixed_keys(1, 1, 2, 1) + _nth_keys(5, 0, 1) + _nth_keys(5, 0, 25) + _nth_keys(8, 0, 25) + _fixed_keys(12, 25, 2, 1) + boxing
    both = _nth_keys(1, 0, 15) + _nth_keys(2, 0, 15) + _nth_keys(5, 0, 25) + _fixed_keys(7, 4, -1, 1) + _nth_keys(9, 0, 1) + _nth_keys(11, 3, 22) + _fixed_keys(12, 25, -1, 1)
    if calendar == "cme":
        return both + _fixed_keys(1, 1, 0, 1)
    if calendar == "us_federal":
        return both + _fixed_keys(1, 1, -1, 1) + _nth_keys(10, 0, 8) + _fixed_keys(11, 11, -1, 1)
    raise ValueError(f"unknown calendar {calendar}")


def weekday_holiday(date: Column, calendar: str) -> Column:
    """Whether a date is a holiday that falls on a weekday."""
    key = F.weekday(date) * 10_000 + F.month(date) * 100 + F.day(date)
    among = lambda keys: F.array_contains(F.expr(f"array({', '.join(map(str, keys))})"), key)
    out = among(_keys(calendar))
    if calendar == "uk":
        out = out | (among(_SPRING[0] + _SPRING[4]) & F.datediff(date, _easter(date)).isin(1, -2))
    if calendar == "cme":
        out = out | (among(_SPRING[4]) & (F.datediff(date, _easter(date)) == -2))
    if calendar != "uk":
        out = out | (among(_fixed_keys(6, 19, -1, 1)) & (F.year(date) >= (2022 if calendar == "cme" else 2021)))
    return out


#: Keys of the Mondays and Fridays among which Easter Monday and Good Friday are.
_SPRING = {w: [w * 10_000 + m * 100 + d for m in (3, 4) for d in range(1, 32)] for w in (0, 4)}


def is_business_day(date: Column, calendar: str = "cme") -> Column:
    return (F.weekday(date) < 5) & ~weekday_holiday(date, calendar)


def _open_days(first: Column, last: Column, calendar: str) -> Column:
    """Business days from first to last, backwards where last is earlier."""
    return F.filter(F.sequence(first, last), lambda d: is_business_day(d, calendar))


def at_or_before(date: Column, calendar: str = "cme") -> Column:
    return F.try_element_at(_open_days(date, F.date_sub(date, 15), calendar), F.lit(1))


def at_or_after(date: Column, calendar: str = "cme") -> Column:
    return F.try_element_at(_open_days(date, F.date_add(date, 15), calendar), F.lit(1))


def ahead(date: Column, n: Column | int, calendar: str = "cme") -> Column:
    """The n-th business day after a date."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("int")
    return F.try_element_at(_open_days(F.date_add(date, 1), F.date_add(date, 3 * n + 15), calendar), n)


def behind(date: Column, n: Column | int, calendar: str = "cme") -> Column:
    """The n-th business day before a date."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("int")
    return F.try_element_at(_open_days(F.date_sub(date, 1), F.date_sub(date, 3 * n + 15), calendar), n)


def shifted(date: Column, n: Column | int, calendar: str = "cme") -> Column:
    """The date n business days on; from a closed day +1 is the next open one and -1 the one before; 0 rolls forward."""
    if isinstance(n, int):
        return ahead(date, n, calendar) if n > 0 else behind(date, -n, calendar) if n < 0 else at_or_after(date, calendar)
    size = F.greatest(F.abs(n), F.lit(1))
    return F.when(n > 0, ahead(date, size, calendar)).when(n < 0, behind(date, size, calendar)).when(n == 0, at_or_after(date, calendar))


def last_business_day_of_month(date: Column, calendar: str = "cme") -> Column:
    return at_or_before(F.last_day(date), calendar)


def holidays_between(first: Column, last: Column, calendar: str = "cme") -> Column:
    """The holidays on weekdays from first to last, as an array; empty where last is earlier."""
    return F.when(first <= last, F.filter(F.sequence(first, last), lambda d: weekday_holiday(d, calendar))).when(first > last, F.array().cast("array<date>"))


def sessions(first: Column, last: Column, calendar: str = "cme") -> Column:
    """The business days from first to last, as an array; empty where last is earlier."""
    return F.when(first <= last, _open_days(first, last, calendar)).when(first > last, F.array().cast("array<date>"))


def session_table(spark: SparkSession, first: dt.date, last: dt.date, calendar: str = "cme") -> DataFrame:
    return spark.range(1).select(F.explode(sessions(F.lit(first), F.lit(last), calendar)).alias("date"))


def looked_up(rows: DataFrame, keys: list[str], out: str, value: Column) -> DataFrame:
    """rows with out, computed once for each distinct value of the keys."""
    names = {k: f"_key{n}" for n, k in enumerate(keys)}
    table = rows.select(*keys).distinct().withColumn(out, value).select(*[F.col(k).alias(n) for k, n in names.items()], out)
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.drop(out).join(table, same, "left").drop(*names.values())


def calendar_for(exchange: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, exchange), F.lit("cme"))


def add_business_days(rows: DataFrame, date: str, n: Column | int | str, out: str, calendar: str = "cme") -> DataFrame:
    """rows with date moved n business days; n is a number or a column's name."""
    if isinstance(n, str):
        return looked_up(rows, [date, n], out, shifted(F.col(date), F.col(n), calendar))
    return looked_up(rows, [date], out, shifted(F.col(date), n, calendar))


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays from start to before end, by arithmetic on whole weeks."""
    through = lambda d: (F.datediff(d, F.lit(dt.date(1990, 1, 1))) / 7).cast("int") * 5 + F.least(F.pmod(F.datediff(d, F.lit(dt.date(1990, 1, 1))), F.lit(7)), F.lit(5))
    return through(end) - through(start)


def month_code(root: Column, date: Column) -> Column:
    return F.concat(root, F.substring(F.lit(MONTH_CODES), F.month(date), F.lit(1)), F.lpad((F.year(date) % 100).cast("string"), 2, "0"))


def expiry(delivery: Column, rule: str) -> Column:
    """A contract's last trading day under a rule, by the first day of its delivery month.

    cl: 3 business days before the 25th of the month before (before the
    business day that precedes it, if it is closed); ng: 3 before the 1st;
    last_bd: the last one of the month before; brent: the last one two months
    before; ttf: 2 before the 1st.
    """
    before = F.add_months(delivery, -1)
    if rule == "cl":
        return behind(at_or_before(F.date_add(before, 24)), 3)
    if rule == "ng":
        return behind(at_or_after(delivery), 3)
    if rule == "ttf":
        return behind(at_or_after(delivery, "uk"), 2, "uk")
    if rule == "last_bd":
        return at_or_before(F.date_sub(delivery, 1))
    if rule == "brent":
        return at_or_before(F.date_sub(before, 1), "uk")
    raise ValueError(f"unknown rule {rule}")


def expiries(months: DataFrame, rule: str) -> DataFrame:
    """months (delivery: first day of the month) with expiry."""
    return looked_up(months, ["delivery"], "expiry", expiry(F.col("delivery"), rule))


def contracts(spark: SparkSession, root: str, first: dt.date, last: dt.date, rule: str) -> DataFrame:
    """(delivery, code, expiry) of the monthly contracts that expire from first to last."""
    months = F.sequence(F.date_sub(F.date_trunc("month", F.lit(first)).cast("date"), 0), F.add_months(F.lit(last), 3), F.expr("interval 1 month"))
    rows = spark.range(1).select(F.explode(months).alias("delivery"))
    rows = rows.withColumn("code", month_code(F.lit(root), F.col("delivery"))).withColumn("expiry", expiry(F.col("delivery"), rule))
    return rows.filter(F.col("expiry").between(F.lit(first), F.lit(last)))
