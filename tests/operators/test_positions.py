"""Positions at close decisions with late reports, and prices by the calendar of an exchange."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendars, services

D = dt.date


def test_every_decision_by_gathering(spark):
    rng = random.Random(6)
    reports, start = [], D(2024, 1, 2)
    for s in "xy":
        for k in range(60):
            late = rng.choice([3, 3, 3, 3, 17, 31])
            day = start + dt.timedelta(days=7 * k)
            reports.append((s, day, float(rng.randrange(400)), 100.0, 1000.0, dt.datetime.combine(day, dt.time()) + dt.timedelta(days=late)))
    reports.append(("x", start + dt.timedelta(days=7 * 60), 5.0, 1.0, 1000.0, None))  # never published
    when = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=k)) for s in "xyz" for k in range(0, 470, 1)]
    got = services.positions_at(
        spark.createDataFrame(reports, "symbol string, date date, long double, short double, open_interest double, available_at timestamp_ntz"), spark.createDataFrame(when, "symbol string, t timestamp_ntz"), weeks=20, least=5
    )
    found = {(r.symbol, r.t): r.positions for r in got.collect()}
    for s, t in when:
        known = sorted((r for r in reports if r[0] == s and r[5] and r[5] <= t), key=lambda r: r[1])
        if not known:
            assert (s, t) not in found
            continue
        p, nets = found[(s, t)], [r[2] - r[3] for r in known]
        assert (p.report_date, p.net, p.released_at) == (known[-1][1], nets[-1], known[-1][5])
        assert p.change == (nets[-1] - nets[-2] if len(nets) > 1 else None)
        seen = nets[-20:]
        rank = 100 * (sum(x < seen[-1] for x in seen) + 0.5 * (seen.count(seen[-1]) - 1)) / max(len(seen) - 1, 1)
        assert p.pctile == (pytest.approx(rank) if len(seen) >= 5 else None)


def test_each_symbol_by_its_exchange(spark):
    rows = spark.sql("SELECT explode(sequence(DATE'2024-01-02', DATE'2024-06-28')) AS date")
    days = [r.date for r in rows.filter(calendars.is_business_day(F.col("date"), "uk")).collect()]
    bars = spark.createDataFrame([(s, d, 10.0 + k % 7, 20.0, 5.0, 11.0 + k % 5, 9.0) for s in ("B", "C") for k, d in enumerate(sorted(days))], "symbol string, date date, open double, high double, low double, close double, volume double")
    table = spark.createDataFrame([("B", "ICE", "none"), ("C", "NYMEX", "none")], "symbol string, exchange string, roll_rule string")
    out = services.prices(bars, table, D(2024, 6, 28))
    wrong = {r.symbol for r in out.issues.filter("check in ('missing_sessions', 'unexpected_sessions')").collect()}
    assert wrong == {"C"}  # the other exchange's holidays
    none = services.prices(bars.filter("symbol = 'B'"), table, D(2023, 1, 1))
    assert [(r.symbol, r.check, r.severity) for r in none.issues.collect()] == [("B", "empty", "error")]
