"""Known values of the time-series operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import backtest, calendars, evaluate, fundamentals, indicators, pit, regimes, risk, rolls, text

D = dt.date


@pytest.mark.parametrize(("rule", "delivery", "expiry"), [
    ("cl", D(2024, 12, 1), D(2024, 11, 20)), ("cl", D(2025, 1, 1), D(2024, 12, 19)), ("cl", D(2020, 5, 1), D(2020, 4, 21)), ("cl", D(2026, 10, 1), D(2026, 9, 22)), ("cl", D(2026, 11, 1), D(2026, 10, 20)),
    ("ng", D(2025, 1, 1), D(2024, 12, 27)), ("ng", D(2026, 8, 1), D(2026, 7, 29)), ("ng", D(2026, 10, 1), D(2026, 9, 28)), ("last_bd", D(2025, 1, 1), D(2024, 12, 31)), ("last_bd", D(2026, 9, 1), D(2026, 8, 31)),
    ("brent", D(2025, 3, 1), D(2025, 1, 31)), ("brent", D(2026, 10, 1), D(2026, 8, 28)), ("brent", D(2026, 11, 1), D(2026, 9, 30)), ("ttf", D(2026, 11, 1), D(2026, 10, 29)),
])
def test_expiry(spark, rule, delivery, expiry):
    assert calendars.expiries(spark.createDataFrame([(delivery,)], "delivery date"), rule).first().expiry == expiry


@pytest.mark.parametrize(("weekday", "period", "release"), [
    ("WED", D(2026, 9, 18), D(2026, 9, 23)), ("WED", D(2026, 9, 4), D(2026, 9, 10)), ("THU", D(2026, 9, 18), D(2026, 9, 24)), ("THU", D(2026, 11, 20), D(2026, 11, 27)),
    ("FRI", D(2026, 9, 15), D(2026, 9, 18)), ("FRI", D(2026, 9, 8), D(2026, 9, 14)), ("FRI", D(2026, 12, 22), D(2026, 12, 28)),
])
def test_release_date(spark, weekday, period, release):
    assert pit.release_dates(spark.createDataFrame([(period,)], "period date"), "period", weekday).first().release_date == release


def test_release_timestamps(spark):
    rows = spark.createDataFrame([(D(2026, 9, 23),), (D(2026, 12, 9),)], "d date")
    got = [r.t for r in rows.select(pit.utc(F.col("d"), "10:30:00", "America/New_York").alias("t")).collect()]
    assert got == [dt.datetime(2026, 9, 23, 14, 30), dt.datetime(2026, 12, 9, 15, 30)]
    late = spark.createDataFrame([(D(2026, 9, 15),), (D(2026, 11, 2),)], "d date").select(pit.next_day_availability(F.col("d"), 1, "America/New_York").alias("t")).collect()
    assert [r.t for r in late] == [dt.datetime(2026, 9, 16, 4), dt.datetime(2026, 11, 3, 5)]


def test_business_days_from_a_closed_day(spark):
    rows = spark.createDataFrame([(D(2026, 7, 4), n) for n in (-1, 0, 1)] + [(D(2026, 7, 6), 0)], "d date, n int")
    got = {(r.d, r.n): r.out for r in calendars.add_business_days(rows, "d", "n", "out").collect()}
    assert got == {(D(2026, 7, 4), -1): D(2026, 7, 2), (D(2026, 7, 4), 0): D(2026, 7, 6), (D(2026, 7, 4), 1): D(2026, 7, 6), (D(2026, 7, 6), 0): D(2026, 7, 6)}


def test_as_of_join_takes_what_was_public(spark):
    series = spark.createDataFrame([(D(2026, 9, 4), 100.0, dt.datetime(2026, 9, 10, 14, 30)), (D(2026, 9, 11), 200.0, dt.datetime(2026, 9, 16, 14, 30)), (D(2026, 9, 18), 300.0, dt.datetime(2026, 9, 23, 14, 30))], "period date, value double, available_at timestamp_ntz")
    sessions = spark.createDataFrame([(D(2026, 9, d), dt.datetime(2026, 9, d, 18, 30)) for d in (9, 18, 22, 23)], "date date, t timestamp_ntz")
    got = {r.date.day: r.value for r in pit.as_of_join(sessions, series, "t", "available_at", ["period", "value"], tie="period").collect()}
    assert got == {9: None, 18: 200.0, 22: 200.0, 23: 300.0}
    exact = spark.createDataFrame([(1, dt.datetime(2026, 9, 16, 14, 30))], "k int, t timestamp_ntz")
    assert pit.as_of_join(exact, series, "t", "available_at", ["value"], tie="period").first().value == 200.0


def test_overrides_make_the_release_path_go_back(spark):
    rows = [(D(2026, 1, 20), dt.datetime(2026, 1, 23)), (D(2026, 1, 27), dt.datetime(2026, 1, 30)), (D(2025, 12, 30), dt.datetime(2026, 1, 2))]
    late = pit.apply_overrides(spark.createDataFrame(rows, "period date, available_at timestamp_ntz"), [(D(2025, 9, 30), D(2025, 12, 30), dt.datetime(2026, 2, 2))])
    day = spark.createDataFrame([(dt.datetime(2026, 2, 4),)], "t timestamp_ntz")
    assert pit.as_of_join(day, late, "t", "available_at", ["period"], tie="period").first().period == D(2025, 12, 30)
    assert pit.as_of_join(day, late, "t", "available_at", ["period"], tie="period", order_by="period").first().period == D(2026, 1, 27)


def test_next_after(spark):
    left, dates = spark.createDataFrame([(D(2026, 1, 5),), (D(2026, 1, 6),)], "d date"), spark.createDataFrame([(D(2026, 1, 5),), (D(2026, 1, 9),)], "e date")
    assert [r.n.day for r in pit.next_after(left, dates, "d", "e", "n").orderBy("d").collect()] == [5, 9]
    assert [r.n.day for r in pit.next_after(left, dates, "d", "e", "n", strict=True).orderBy("d").collect()] == [9, 9]


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [("x", D(2020, 1, 1) + dt.timedelta(k), *(v[k] for v in columns.values())) for k in range(n)]
    kinds = ", ".join(f"{c} {'boolean' if isinstance(next((x for x in v if x is not None), 0.0), bool) else 'double'}" for c, v in columns.items())
    return spark.createDataFrame(rows, f"symbol string, date date, {kinds}")


def test_backtest_by_hand(spark):
    rows = series(spark, open=[100.0, 102.0, 99.0, 104.0], close=[101.0, 100.0, 103.0, 105.0], target=[1.0, None, 0.5, None], roll=[False] * 4)
    got = [r.equity for r in backtest.run(rows, 0.001, 0.0005).orderBy("date").collect()]
    one = (1 - 0.0015) * (100 / 102)
    two = one * (99 / 100) * (103 / 99)
    assert got == pytest.approx([1, one, two, two * (104 / 103) * (1 - 0.00075) * (1 + 0.5 * (105 / 104 - 1))], abs=1e-12)


def test_no_position_before_the_first_target(spark):
    rows = series(spark, open=[100.0, 110.0], close=[100.0, 120.0], target=[None, None], roll=[False] * 2)
    assert [r.position for r in backtest.run(rows).collect()] == [0, 0]
    held = backtest.run(backtest.buy_and_hold(series(spark, open=[100.0, 110.0, 130.0], close=[105.0, 120.0, 140.0], roll=[False] * 3)), 0.0)
    assert held.orderBy(F.col("date").desc()).first().equity == pytest.approx(140 / 110)


def test_pnl_bars_on_a_roll_day(spark):
    rows = series(spark, open=[100.0, 101.0, 80.0, 81.0, 82.0], close=[100.0, 102.0, 82.0, 83.0, 84.0], valid=[True, True, False, True, True], roll=[False, False, True, False, False])
    got = backtest.pnl_bars(rows).orderBy("date").collect()
    assert got[2].overnight == 1 and got[2].intraday == pytest.approx(82 / 80)


def test_holm_and_blend(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "model string, p double")
    assert {r.model: r.p_adj for r in evaluate.holm(rows).collect()} == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None}
    preds = spark.createDataFrame([("x", "a", 1, 0, 1, None, 1.0, 1.0, 0.5), ("x", "b", 1, 0, 1, 1.0, 1.0, 1.0, 0.5), ("x", "a", 1, 0, 2, 2.0, 2.0, 2.0, 0.5), ("x", "b", 1, 0, 2, 4.0, 4.0, 4.0, 0.5)], "symbol string, model string, horizon int, fold int, pos int, q10 double, q50 double, q90 double, p_up double")
    weights = spark.createDataFrame([("x", 0, "a", 0.25), ("x", 0, "b", 0.75)], "symbol string, fold int, model string, weight double")
    assert [r.q10 for r in evaluate.blend(preds, weights, "mix").orderBy("pos").collect()] == pytest.approx([1, 0.25 * 2 + 0.75 * 4])


def test_spacing_pinball_and_folds(spark):
    rows = spark.createDataFrame([("m", p) for p in range(0, 41, 5)], "model string, pos long")
    assert sorted(r.pos for r in evaluate.spaced(rows, ["model"], 20).collect()) == [0, 20, 40]
    got = spark.createDataFrame([(0.0,), (1.0,)], "y double").select(evaluate.pinball(F.col("y"), F.lit(0.0), 0.9).alias("l")).collect()
    assert [r.l for r in got] == pytest.approx([0, 0.9])
    plan = evaluate.Plan(min_train=30, step=7, max_folds=4)
    sizes = spark.createDataFrame([("x", 60), ("y", 30), ("z", 48)], "symbol string, n int")
    got = sorted(tuple(r) for r in evaluate.fold_table(sizes, plan).collect())
    starts = {30: (30, 35), 37: (40,), 44: (45, 50), 51: (55,), 58: ()}
    rows = [(s - 6, p) for s in starts for p in starts[s]]
    ends = sorted({e for e, _ in rows})[-4:]
    assert [(f, e, p) for symbol, f, e, p in got if symbol == "x"] == [(ends.index(e), e, p) for e, p in rows if e in ends]
    assert [(f, e, p) for symbol, f, e, p in got if symbol == "z"] == [(0, 24, 30), (0, 24, 35), (1, 31, 40), (2, 38, 45)] and not any(s == "y" for s, *_ in got)


def test_distributions():
    assert stats.student_cdf(2.0, 5) == pytest.approx(0.9490302605850709, abs=1e-12)
    assert stats.student_cdf(-1.0, 1) == pytest.approx(0.25, abs=1e-12)
    for k, n, p in ((3, 10, 0.5), (9, 12, 0.6), (0, 4, 0.1)):
        assert stats.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), abs=1e-12)
    assert stats.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)


def test_block_test_sees_a_difference(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(rng.normal(-0.5, 1, 200))] + [("b", k, float(x)) for k, x in enumerate(rng.normal(0, 1, 200))], "model string, pos int, d double")
    p = {r.model: r.p for r in evaluate.block_test(rows, ["model"], 10).collect()}
    assert p["a"] < 0.01 < p["b"]


def test_risk_values(spark):
    falls = lambda *r: risk.max_drawdown(series(spark, r=list(r))).first().max_drawdown
    assert falls(0.1, -0.2, 0.05) == pytest.approx(-0.2) and falls(-0.1, 0.05) == pytest.approx(-0.1)
    assert risk.cvar_historical(series(spark, r=[-0.10 + 0.01 * k for k in range(20)]), 0.9).first().cvar == pytest.approx(0.095)
    rates = series(spark, r=[0.1, -0.1, 0.2, 0.0, None]).groupBy("symbol").agg(risk.hit_rate(F.col("r")).alias("h"))
    assert rates.first().h == pytest.approx(2 / 3)


def test_curves_and_weeks(spark):
    shapes = {"back": [92.41, 88.71, 86.01], "up": [80, 82, 85], "mixed": [3.2, 3.5, 3.9, 2.8], "flat": [50, 50.01], "one": [50]}
    rows = [(k, D(2026, 1, 1) + dt.timedelta(30 * i), float(x)) for k, v in shapes.items() for i, x in enumerate(v)]
    got = {r.symbol: r for r in fundamentals.curve_metrics(spark.createDataFrame(rows, "symbol string, expiry date, settle double")).collect()}
    assert [got[k].shape for k in shapes] == ["backwardation", "contango", "mixed", "flat", None]
    assert got["back"].m1_m2 == pytest.approx(3.70) and got["one"].m1_m2 is None
    weeks = spark.createDataFrame([(D(2020, 12, 31),), (D(2021, 1, 1),)], "d date").select(fundamentals.folded_week(F.col("d")).alias("w")).collect()
    assert [r.w for r in weeks] == [52, 52]
    legs = spark.createDataFrame([(D(2026, 1, 1), 70.0, 2.0, 2.5), (D(2026, 1, 2), None, 2.0, 2.5)], "date date, cl double, rb double, ho double")
    assert [r.spread for r in fundamentals.spread_321(legs).collect()] == pytest.approx([(168 + 105 - 210) / 3])


def test_recursions():
    x = np.arange(1.0, 8.0)
    assert np.allclose(indicators.recursive_average(x, 3, 0.5)[2:], [2, 3, 4, 5, 6]) and np.isnan(indicators.ema(x, 9)).all()
    assert indicators.rsi(np.full(20, 5.0))[-1] == 50 and indicators.rsi(np.arange(20.0))[-1] == 100
    with pytest.raises(ValueError):
        indicators.ema(np.array([1, np.nan, 3, 4.0]), 2)
    assert regimes.levels([90, 91, 97, 104, 111], 100, 1.5, 2) == [("support", 97, 1), ("support", 90.5, 2), ("resistance", 104, 1), ("resistance", 111, 1)]


def test_roll_masks_and_levels(spark):
    n = 12
    close = [100.0 + k for k in range(n)]
    close[7:] = [c - 30 for c in close[7:]]
    volume = [10.0] * n
    volume[7] = 40.0
    bars = series(spark, open=close, high=close, low=close, close=close, volume=volume)
    windows = spark.createDataFrame([("x", D(2020, 1, 8), D(2020, 1, 4), D(2020, 1, 9))], "symbol string, expiry date, start date, end date")
    found = rolls.detect_rolls(bars, windows)
    assert (found.first().roll_date, found.first().method) == (D(2020, 1, 8), "volume")
    out = rolls.adjusted(rolls.masked_returns(bars, found)).orderBy("date").collect()
    assert [r.date.day for r in out if r.reason == "roll"] == [8, 9] and out[0].reason == "missing"
    assert out[-1].close_adj == pytest.approx(close[-1]) and out[6].close_adj == pytest.approx(out[7].close_adj)


def test_text_claims(spark):
    rows = spark.createDataFrame([(1, "It fell -2.3% to $91.50 on 1.2bn of volume"), (2, "M1-M2 at T3 with CLZ26 on 2026-01-05 12:30")], "id int, t string")
    got = {(r.id, r.raw): (r.value, r.decimals, r.percent) for r in text.claims(rows, "t", "id").collect()}
    assert got == {(1, "-2.3%"): (2.3, 1, True), (1, "$91.50"): (91.5, 2, False), (1, "1.2bn"): (1.2, 1, False)}
    one = spark.range(1).select(text.cited_ids(F.lit("a [T10] b [T2] [T10]")).alias("c"), text.redacted(F.lit("u?api_key=abc&x=1")).alias("r"), text.written_decimals(F.lit(1.25)).alias("w"), text.normalised(F.lit(" A-b!c ")).alias("n")).first()
    assert (one.c, one.r, one.w, one.n) == ([2, 10], "u?api_key=***&x=1", 2, "a b c")


def test_calendar_rules_match_plain_dates(spark):
    days = spark.range(1).select(F.explode(F.sequence(F.lit(D(1970, 1, 1)), F.lit(D(2060, 12, 31)))).alias("d"))
    for name in ("cme", "uk", "us_federal"):
        got = {r.d for r in days.filter(calendars.weekday_holiday(F.col("d"), name)).collect()}
        assert got == {d for _, d in calendars.holiday_rows(name, 1970, 2060)}


def test_dates_far_away_and_null(spark):
    rows = spark.createDataFrame([(D(1980, 7, 3),), (D(2024, 7, 3),), (D(2045, 7, 3),), (None,)], "d date")
    got = {r.d: r.out for r in calendars.add_business_days(rows, "d", 1, "out").collect()}
    assert got == {D(1980, 7, 3): D(1980, 7, 7), D(2024, 7, 3): D(2024, 7, 5), D(2045, 7, 3): D(2045, 7, 5), None: None}
    out = {r.d: r.release_date for r in pit.release_dates(rows, "d", "WED").collect()}
    assert len(out) == 4 and out[D(2045, 7, 3)] == D(2045, 7, 6) and out[None] is None
    one = rows.select("d", calendars.last_business_day_of_month(F.col("d")).alias("l"), calendars.holidays_between(F.col("d"), F.date_add("d", 5)).alias("h"), calendars.calendar_for(F.lit("ICE")).alias("c")).collect()
    assert {r.d: (r.l, r.h) for r in one}[D(2024, 7, 3)] == (D(2024, 7, 31), [D(2024, 7, 4)]) and one[0].c == "uk"
    codes = [(r.code, r.expiry) for r in calendars.contracts(spark, "CL", D(2024, 11, 1), D(2024, 12, 31), "cl").orderBy("delivery").collect()]
    assert codes == [("CLZ24", D(2024, 11, 20)), ("CLF25", D(2024, 12, 19))]


def test_overrides_keep_every_vintage(spark):
    rows = [(D(2026, 1, 9), 1.0, dt.datetime(2026, 1, 10)), (D(2026, 1, 9), 1.0, dt.datetime(2026, 1, 11)), (None, 2.0, dt.datetime(2026, 1, 1)), (D(2026, 1, 9), 3.0, None)]
    out = pit.apply_overrides(spark.createDataFrame(rows, "period date, value double, available_at timestamp_ntz"), [(D(2026, 2, 1), D(2026, 3, 1), dt.datetime(2026, 5, 1))])
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, rows))


def test_position_size_gates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0.4, 300, None), (1, 4.0, 300, 0.0), (2, nan, 300, 0.0), (3, inf, 300, 0.0), (4, None, 300, 0.0), (5, 0.0, 300, 0.0), (6, 0.2, 100, -0.9), (7, 0.2, 300, -0.3), (8, 0.8, 300, -0.1)]
    got = {r.k: r for r in risk.position_size(spark.createDataFrame(rows, "k int, vol double, history_days int, strategy_drawdown double")).collect()}
    assert [(got[k].fraction, got[k].binding) for k in range(9)] == [(0.25, "max_position_fraction"), (0.05, "vol_target"), *[(0.0, "invalid_vol")] * 4, (0.0, "min_history_days"), (0.0, "max_drawdown_stop"), (0.25, "vol_target")]
    assert got[0].vol_target_fraction == 0.5 and got[2].vol_target_fraction is None and got[7].reasons == ["strategy drawdown -30.0% beyond stop -30%"]
    assert got[0].reasons == ["vol target 20% / realized 40.0% = 0.50", "capped by max_position_fraction"]


def test_checked_text(spark):
    payloads = [("T1", '{"stocks": 426398, "change": 0.0742, "label": "near 12.5% of 3.2bn", "result_id": 99}'), ("T2", '{"units": "%", "level": 55.2, "vol_pctile": 0.31}'), ("T3", '{"error": "no data for 500"}'), ("T4", '{"x": [1.2345e9, true, null, {"deep": -139.5}]}')]
    values = text.tool_values(spark.createDataFrame(payloads, "result_id string, payload string"))
    cases = [
        ("Stocks are 426k, up 7.4% [T1].", []), ("Stocks are 427k [T1].", ["427k"]), ("The level is 55.2% and 55.2 [T2].", []), ("A share of 55.3% [T2].", ["55.3%"]), ("It fell 742bps [T1].", []),
        ("Quoted 12.5% and 3.2bn [T1].", []), ("Down $139.50 to $1.2bn [T4].", []), ("Over 20 days, 3 analysts since 2019, P10 of M1 and the 3-2-1 on 2026-01-05 at 10:30, 20d [T1].", []), ("The 55th percentile [T2].", []),
        ("It is 500 [T3].", ["500"]), ("It is 500.", [None]), ("It is 500 [T8].", ["T8"]), ("Roughly double.", []), ("Both 426,398 and 55.2 [T1, T2].", []), ("In 2025 it was 2025.5 [T1].", ["2025.5"]),
    ]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    keyed = spark.range(len(cases)).select(F.col("id").cast("int").alias("k")).crossJoin(values)
    found = text.check_text(rows, "t", keyed, "k")
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append(r.raw)
    assert got == {k: want for k, (_, want) in enumerate(cases) if want}
    bad = {r.k: r.t for r in text.without_unsupported(rows, "t", found, "k").collect()}
    assert bad[1] == "" and bad[0] == cases[0][0]
    fields = spark.createDataFrame([(0, '{"a": "It is 426k [T1].", "b": ["It is 9,999 [T1]."]}')], "k int, j string")
    assert [(r.k, r.raw) for r in text.check_fields(fields, "j", keyed, "k").collect()] == [(0, "9,999")]
    signed = spark.range(1).select(*[text.signed_match(F.lit(v), F.lit(1), F.lit(p), text.known(F.array(F.lit(-0.139)))).alias(n) for n, v, p in (("a", -13.9, True), ("b", 13.9, True), ("c", -0.1, False))]).first()
    assert (signed.a, signed.b, signed.c) == (True, False, True)
