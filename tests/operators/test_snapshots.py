"""Snapshots: a prefix of the data gives the same blocks, and each block against its rule written out."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshots

D = dt.date
BARS = "symbol string, date date, open double, high double, low double, close double, volume double, ret double"


def series(symbol, n, seed):
    rng, out, close, day = random.Random(seed), [], 100.0, D(2022, 1, 3)
    while len(out) < n:
        if day.weekday() < 5:
            new = close * math.exp(rng.gauss(0, 0.02))
            out.append((symbol, day, close, max(close, new) + 1, min(close, new) - 1, new, 10.0, None if rng.random() < 0.03 or not out else math.log(new / close)))
            close = new
        day += dt.timedelta(1)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = series("a", 420, 1) + series("b", 330, 2)
    decisions = [(s, D(2022, 1, 1) + dt.timedelta(days=k)) for s in "ab" for k in range(0, 600, 37)]
    return rows, decisions


def frames(spark, rows, decisions):
    return spark.createDataFrame(rows, BARS), spark.createDataFrame(decisions, "symbol string, date date")


def others(spark):
    weekly = spark.createDataFrame([(D(2020, 1, 3) + dt.timedelta(days=7 * k), 100.0 + k % 52 + k / 10, dt.datetime(2020, 1, 8, 15) + dt.timedelta(days=7 * k)) for k in range(190)], "period date, value double, available_at timestamp_ntz")
    reports = spark.createDataFrame([("a", D(2022, 1, 4) + dt.timedelta(days=7 * k), 300.0 + k * k % 17, 100.0, 1000.0, dt.datetime(2022, 1, 7, 20) + dt.timedelta(days=7 * k)) for k in range(80)], "symbol string, date date, long double, short double, open_interest double, available_at timestamp_ntz")
    legs = spark.createDataFrame([(D(2022, 1, 3) + dt.timedelta(days=k), 70.0 + k % 7, 2.0 + k % 5 / 10, None if k % 11 == 0 else 2.5) for k in range(500)], "date date, cl double, rb double, ho double")
    settles = spark.createDataFrame([("a", e, D(2022, 3, 1) + dt.timedelta(days=k), 70.0 - m) for m, e in enumerate((D(2022, 6, 20), D(2022, 7, 20), D(2022, 8, 22), D(2022, 9, 20))) for k in range(0, 60, 3) if m != 2 or k < 6], "symbol string, expiry date, day date, settle double")
    issues = spark.createDataFrame([("a", "gap", "warn", D(2022, 5, 1)), ("a", "empty", "error", D(2022, 7, 1)), ("a", "rolls", "info", D(2022, 1, 5)), ("a", "gap", "warn", D(2022, 8, 1))], "symbol string, check string, severity string, date date")
    return {"weekly": weekly, "reports": reports, "legs": legs, "settles": settles, "issues": issues}


def test_a_prefix_gives_the_same_blocks(spark, data):
    rows, decisions = data
    cut = D(2022, 12, 1)
    early = [d for d in decisions if d[1] <= cut]
    more = others(spark)
    whole = snapshots.snapshot_at(*frames(spark, rows, early), **more)
    seen = {k: v.filter(F.col({"weekly": "available_at", "reports": "available_at", "legs": "date", "settles": "day", "issues": "date"}[k]) <= F.lit(cut)) for k, v in more.items()}
    part = snapshots.snapshot_at(*frames(spark, [r for r in rows if r[1] <= cut], early), **seen)
    order = ["symbol", "date"]
    one, two = (frame.orderBy(*order).collect() for frame in (whole, part))
    assert one == two and len(one) > 15


def test_blocks_by_their_rules(spark, data):
    rows, decisions = data
    got = {(r.symbol, r.date): r for r in snapshots.snapshot_at(*frames(spark, rows, decisions), **others(spark)).collect()}
    assert len(got) == sum(d[1] >= D(2022, 1, 3) for d in decisions)
    for (symbol, date), r in got.items():
        own = [x for x in rows if x[0] == symbol and x[1] <= date]
        level = [1.0]
        for x in own:
            level.append(level[-1] * math.exp(x[7] or 0.0))
        level = level[1:]
        assert (r.price.last_date, r.price.last_close) == (own[-1][1], own[-1][5])
        if len(own) > 20:
            assert r.price.change_20d == pytest.approx(level[-1] / level[-21] - 1) and r.technicals.sma20 == pytest.approx(sum(level[-20:]) / 20 / level[-1] * own[-1][5])
        before = [v for v, x in zip(level, own, strict=True) if x[1].year < own[-1][1].year]
        assert r.price.change_ytd == (pytest.approx(level[-1] / before[-1] - 1) if before else None)
        simple = [math.expm1(x[7]) for x in own[-252:] if x[7] is not None]
        assert (r.risk.year.n if r.risk.year else 0) == len(simple)
        curve = r.curve
        if symbol == "a" and D(2022, 3, 10) < date < D(2022, 3, 30):
            assert curve.m1_m2 == 1.0 and curve.contracts == 4 and curve.shape == "backwardation"
        elif symbol == "a" and D(2022, 4, 7) < date < D(2022, 5, 20):  # the third has no recent settle
            assert curve.contracts == 2 and curve.m1_m2_pct == pytest.approx(1 / 69)
        elif symbol == "b" or date > D(2022, 10, 1):
            assert curve is None
        assert r.notes == [n for since, n in ((D(2022, 7, 1), "data quality [error] empty"), (D(2022, 5, 1), "data quality [warn] gap")) if symbol == "a" and since <= own[-1][1]]
        day = max(own[-1][1] - dt.timedelta(days=k) for k in range(9) if ((own[-1][1] - D(2022, 1, 3)).days - k) % 11 and (own[-1][1] - D(2022, 1, 3)).days - k >= 0) if own[-1][1] > D(2022, 1, 4) else None
        if day and day <= D(2023, 5, 1):
            k = (day - D(2022, 1, 3)).days
            assert r.crack.date == day and r.crack.value == pytest.approx((2 * (2.0 + k % 5 / 10) * 42 + 2.5 * 42 - 3 * (70.0 + k % 7)) / 3)
        if symbol == "a" and date > D(2022, 1, 20):
            assert r.cot.released_at.date() <= own[-1][1] and r.cot.change is not None


def test_anonymous_form_names_nothing(spark, data):
    rows, decisions = data
    whole = snapshots.snapshot_at(*frames(spark, rows, decisions))
    out = snapshots.anonymous(whole)
    assert {t for _, t in out.dtypes if "date" in t} == set() and "symbol" not in out.columns
    first = out.filter("decision = 1").collect()
    assert [r.price.last_close for r in first] == pytest.approx([100.0, 100.0]) and len({r.series for r in first}) == 2
    scaled = snapshots.anonymous(snapshots.snapshot_at(spark.createDataFrame([(s, d, o * 3, h * 3, lo * 3, c * 3, v, r) for s, d, o, h, lo, c, v, r in rows], BARS), frames(spark, rows, decisions)[1]))
    key = lambda frame: sorted((r.series, r.decision, round(r.price.last_close, 6), round(r.price.high_52w, 4)) for r in frame.collect())
    assert key(out) == key(scaled)
