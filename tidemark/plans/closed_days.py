"""Queries over exchange calendars; the SQL has the closed days of the tables' years as values, the operators work for any date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import functions as F

from tidemark.operators import calendars, pit, quality
from tidemark.sources.tables import table

from .catalog import register

FIRST, LAST = 1994, 2003


def days_sql(calendar: str) -> str:
    closed = ", ".join(f"(DATE '{d}')" for _, d in calendars.holiday_rows(calendar, FIRST, LAST))
    return f"""closed(d) AS (VALUES {closed}), days AS (
  SELECT CAST(g AS DATE) AS date, isodow(g) < 6 AND CAST(g AS DATE) NOT IN (SELECT d FROM closed) AS is_bd FROM generate_series(DATE '{FIRST}-01-01', DATE '{LAST}-12-31', INTERVAL 1 DAY) t(g)),
idx AS (SELECT *, CAST(sum(CAST(is_bd AS INT)) OVER (ORDER BY date) AS BIGINT) AS le FROM days), bds AS (SELECT date, le FROM idx WHERE is_bd)"""


def add(day_bars: Callable) -> None:
    """Register the calendar queries over these bars."""
    register("calendar_sessions", f"WITH {days_sql('cme')} SELECT strftime(date, '%Y-%m-%d') AS date FROM bds")(lambda spark, sf_dir: calendars.session_table(spark, dt.date(FIRST, 1, 1), dt.date(LAST, 12, 31)).select(F.date_format("date", "yyyy-MM-dd").alias("date")))
    for name, n in (("add_business_days_pos", 3), ("add_business_days_neg", -2), ("add_business_days_zero", 0)):
        at = f"i.le + {n}" if n > 0 else f"i.le + CASE WHEN i.is_bd THEN 0 ELSE 1 END + ({n})"
        register(name, f"WITH {days_sql('cme')} SELECT o_orderkey, strftime(b.date, '%Y-%m-%d') AS moved FROM orders JOIN idx i ON i.date = CAST(o_orderdate AS DATE) JOIN bds b ON b.le = {at}")(
            lambda spark, sf_dir, n=n: calendars.add_business_days(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")), "d", n, "moved").select("o_orderkey", F.date_format("moved", "yyyy-MM-dd").alias("moved"))
        )
    for rule, calendar, anchor, back in (("cl", "cme", "CAST(m - INTERVAL 1 MONTH AS DATE) + 24", 3), ("ng", "cme", "m", 3), ("last_bd", "cme", "m - 1", 0), ("brent", "uk", "CAST(m - INTERVAL 1 MONTH AS DATE) - 1", 0), ("ttf", "uk", "m", 2)):
        ge = "+ CASE WHEN i.is_bd THEN 0 ELSE 1 END" if rule in ("ng", "ttf") else ""
        register(f"expiry_{rule}", f"WITH {days_sql(calendar)}, months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) SELECT strftime(m, '%Y-%m-%d') AS delivery, strftime(b.date, '%Y-%m-%d') AS expiry FROM months JOIN idx i ON i.date = {anchor} JOIN bds b ON b.le = i.le {ge} - {back}")(
            lambda spark, sf_dir, rule=rule: calendars.expiries(table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("delivery")).distinct(), rule).select(F.date_format("delivery", "yyyy-MM-dd").alias("delivery"), F.date_format("expiry", "yyyy-MM-dd").alias("expiry"))
        )
    register("contract_codes", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, 'CL' || substr('FGHJKMNQUVXZ', month(o_orderdate), 1) || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS code FROM orders")(
        lambda spark, sf_dir: table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).distinct().withColumn("code", calendars.month_code(F.lit("CL"), F.col("m")))
    )
    register("weekdays_between", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT count(*) FROM generate_series(CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + 44, INTERVAL 1 DAY) t(g) WHERE isodow(g) < 6) AS n FROM lineitem")(
        lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", calendars.weekdays_between(F.to_date("l_shipdate"), F.date_add(F.to_date("l_shipdate"), 45)).cast("bigint").alias("n"))
    )
    weeks = "weeks AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS period FROM lineitem)"
    register("release_date_weekly", f"WITH {days_sql('us_federal')}, {weeks}, n AS (SELECT period, period + 5 AS nominal FROM weeks), k AS (SELECT period, nominal, (SELECT count(*) FROM closed WHERE d BETWEEN nominal - 2 AND nominal) AS k FROM n) SELECT strftime(period, '%Y-%m-%d') AS period, strftime(CASE WHEN k = 0 THEN nominal ELSE b.date END, '%Y-%m-%d') AS release_date FROM k JOIN idx i ON i.date = nominal LEFT JOIN bds b ON b.le = i.le + k.k")(
        lambda spark, sf_dir: pit.release_dates(table(spark, sf_dir, "lineitem").select(F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 4).alias("period")).distinct(), "period", "WED").select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.date_format("release_date", "yyyy-MM-dd").alias("release_date"))
    )
    bars = "b AS (SELECT DISTINCT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders), e AS (SELECT symbol, min(date) AS f, max(date) AS l FROM b GROUP BY 1), s AS (SELECT e.symbol, bds.date FROM e JOIN bds ON bds.date BETWEEN e.f AND e.l)"
    head = f"WITH {days_sql('cme')}, {bars}"

    def check(f):
        def query(spark, sf_dir):
            rows = day_bars(spark, sf_dir)
            return f(rows, quality.expected_sessions(rows))

        return query

    register("q_missing_sessions", f"{head} SELECT symbol, strftime(date, '%Y-%m-%d') AS date FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = s.symbol AND b.date = s.date)")(check(lambda rows, sessions: quality.missing_sessions(rows, sessions).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"))))
    register("q_unexpected_sessions", f"{head} SELECT symbol, strftime(date, '%Y-%m-%d') AS date FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE b.symbol = s.symbol AND b.date = s.date)")(check(lambda rows, sessions: quality.unexpected_sessions(rows, sessions).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"))))
    register("q_gap_islands", f"{head}, m AS (SELECT s.symbol, s.date, b.date IS NULL AS gone FROM s LEFT JOIN b ON b.symbol = s.symbol AND b.date = s.date), r AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date) AS run FROM m) SELECT symbol, strftime(min(date), '%Y-%m-%d') AS date, CAST(count(*) AS DOUBLE) AS detail FROM r WHERE gone GROUP BY symbol, run HAVING count(*) > 2")(check(lambda rows, sessions: quality.gaps(rows, sessions).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), "detail")))
