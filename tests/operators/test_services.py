"""Services, decisions and figure data on small tables whose answers are written out."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import backtest, decisions, figures, fundamentals, quality, reports, services

D = dt.date


def bars(spark, symbol="CL", first=D(2024, 11, 1), n=40, jump=None):
    rows, day = [], first
    while len(rows) < n:
        if day.weekday() < 5:
            k = len(rows)
            rows.append((symbol, day, 70.0 + k, 71.0 + k, 69.0 + k, 70.5 + k, 40.0 if day == jump else 10.0))
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


INSTRUMENTS = [("CL", "NYMEX", "cl", "CL", "067651"), ("NG", "NYMEX", "ng", "NG", "023651")]
SCHEMA = "symbol string, exchange string, roll_rule string, contract_root string, market_code string"


def test_prices_see_nothing_later(spark):
    table = spark.createDataFrame(INSTRUMENTS, SCHEMA)
    rows = bars(spark, jump=D(2024, 11, 19)).unionByName(bars(spark, "XYZ"))
    found = services.roll_windows(rows, table).persist()
    windows = {(r.symbol, r.expiry): (r.start, r.end) for r in found.collect()}
    assert windows[("CL", D(2024, 11, 20))] == (D(2024, 11, 14), D(2024, 11, 21)) and ("XYZ", D(2024, 11, 20)) not in windows
    out = services.prices(rows, table, D(2024, 12, 6))
    rolled = out.frame.filter("reason = 'roll'").select("symbol", "date").collect()
    assert [tuple(r) for r in sorted(rolled)] == [("CL", D(2024, 11, 19)), ("CL", D(2024, 11, 20))]
    assert out.frame.agg(F.max("date")).first()[0] == D(2024, 12, 6)
    checks = {(r.symbol, r.check): r for r in quality.by_check(out.issues).collect()}
    assert checks[("CL", "rolls")].dates == [D(2024, 11, 19)] and checks[("CL", "rolls")].ok
    one = services.instruments_of(spark.createDataFrame([("ABC",), ("CL",)], "symbol string"), table).orderBy("symbol").collect()
    assert [(r.exchange, r.roll_rule) for r in one] == [("NYSE Arca", "none"), ("NYMEX", "cl")]
    flat = services.feature_returns(bars(spark), found).collect()
    assert [r.date for r in flat if r.in_window][:6] == [D(2024, 11, d) for d in (14, 15, 18, 19, 20, 21)] and all(r.ret is None for r in flat if r.in_window)
    assert [r.symbol for r in quality.empty(spark.createDataFrame([("CL",), ("Q",)], "symbol string"), rows).collect()] == ["Q"]


def test_series_and_what_was_known(spark):
    weekly = spark.createDataFrame([(D(2026, 8, 28), 1.0), (D(2026, 9, 4), 2.0), (None, 3.0)], "period date, value double")
    schedule = services.Schedule("WED", "10:30:00")
    got = {r.period: r.available_at for r in services.weekly_series(weekly, schedule, [(D(2026, 8, 25), D(2026, 8, 30), D(2026, 9, 20))]).collect()}
    assert got == {D(2026, 8, 28): dt.datetime(2026, 9, 20, 14, 30), D(2026, 9, 4): dt.datetime(2026, 9, 10, 14, 30), None: None}
    vintages = spark.createDataFrame([("DGS10", D(2026, 1, 2), 4.0, D(2026, 1, 5)), ("DGS10", D(2026, 1, 2), 4.5, D(2026, 2, 5)), ("DGS10", D(2026, 1, 5), 4.2, D(2026, 1, 6))], "series string, date date, value double, realtime_start date")
    first = services.first_releases(vintages)
    assert sorted((r.date, r.value, r.available_at) for r in first.collect()) == [(D(2026, 1, 2), 4.0, dt.datetime(2026, 1, 6, 5)), (D(2026, 1, 5), 4.2, dt.datetime(2026, 1, 7, 5))]
    last = services.macro_last(first, F.lit(dt.datetime(2026, 1, 6, 12)), 1).first()
    assert (last.last_date, last.last, last.change_20_obs) == (D(2026, 1, 2), 4.0, None)
    reports_ = [("CL", D(2026, 1, 6), 300.0, 100.0, 1000.0, 5.0, 9.0, dt.datetime(2026, 1, 9, 20)), ("CL", D(2026, 1, 13), 350.0, 100.0, 1000.0, 5.0, 8.0, dt.datetime(2026, 1, 16, 20))]
    cot = spark.createDataFrame(reports_, "symbol string, date date, long double, short double, open_interest double, commercial_long double, commercial_short double, available_at timestamp_ntz")
    when = spark.createDataFrame([("CL", dt.datetime(2026, 1, 16, 19)), ("CL", dt.datetime(2026, 1, 16, 20))], "symbol string, t timestamp_ntz")
    at = {r.t: r.positions for r in services.positions_at(cot, when).collect()}
    assert at[dt.datetime(2026, 1, 16, 19)].net == 200 and at[dt.datetime(2026, 1, 16, 20)].commercial_net == -3 and at[dt.datetime(2026, 1, 16, 20)].report_date == D(2026, 1, 13)


def test_events_curves_and_cracks(spark):
    dates = spark.createDataFrame([(D(2026, 9, 9),), (D(2026, 9, 10),), (D(2026, 9, 11),)], "as_of date")
    got = {r.as_of: r.date for r in services.event_calendar(dates, {"petroleum": ("FRI", services.Schedule("WED", "10:30:00"))}).collect()}
    assert got == {D(2026, 9, 9): D(2026, 9, 10), D(2026, 9, 10): D(2026, 9, 10), D(2026, 9, 11): D(2026, 9, 16)}
    row = dates.limit(1).select(services.next_expiry(F.lit(D(2024, 11, 21)), "cl").alias("e"), services.sessions_to_roll(F.lit(D(2024, 12, 17)), "cl").alias("s"), services.sessions_to_roll(F.lit(D(2024, 12, 17)), "none").alias("n"), services.in_hurricane_season(F.lit(D(2024, 6, 1))).alias("h"), services.in_hurricane_season(F.lit(D(2024, 12, 1))).alias("g")).first()
    assert (row.e, row.s, row.n, row.h, row.g) == (D(2024, 12, 19), 2, None, True, False)
    curve = spark.createDataFrame([("CL", D(2026, 1, 20), 70.0), ("CL", D(2026, 2, 20), 69.0), ("NG", D(2026, 1, 28), 3.0)], "symbol string, expiry date, settle double")
    only = services.curve_at(curve).collect()
    assert [(r.symbol, len(r.contracts), r.metrics.shape) for r in only] == [("CL", 2, "backwardation")]
    legs = [(s, D(2026, 1, d), p + d / 10, "roll" if s == "rb" and d == 7 else None) for s, p in (("cl", 70.0), ("rb", 2.0), ("ho", 2.2)) for d in (5, 6, 7, 8)]
    crack = services.crack_at(spark.createDataFrame(legs, "symbol string, date date, close double, reason string"), F.lit(D(2026, 1, 7))).first()
    assert crack.date == D(2026, 1, 7) and crack.roll_affected and crack.value == pytest.approx((2 * 2.7 * 42 + 2.9 * 42 - 3 * 70.7) / 3) and crack.pctile_1y == 100


def test_decisions(spark):
    horizons = spark.createDataFrame([("CL", 1, 0.8, True), ("CL", 5, 0.6, True), ("CL", 20, 0.1, False), ("NG", 1, 0.9, False)], "symbol string, horizon int, p_up double, edge boolean")
    signal = decisions.forecast_signal(horizons)
    got = {r.symbol: r for r in signal.collect()}
    assert got["CL"].signal == pytest.approx(0.4) and got["CL"].note == "edge at 1d, 5d" and (got["NG"].signal, got["NG"].has_edge) == (0.0, False)
    views = spark.createDataFrame([("CL", "macro", "bullish", 0.5), ("NG", "macro", "bearish", 1.0)], "symbol string, agent string, stance string, confidence double")
    out = {r.symbol: r for r in decisions.decide(views, signal, {"forecast": 0.5, "macro": 0.3, "silent": 0.2}).collect()}
    assert out["CL"].score == pytest.approx(0.5 * 0.4 + 0.3 * 0.5) and out["NG"].score == pytest.approx(-0.3) and out["CL"].forecast_edge
    assert {c.name: c.note for c in out["NG"].components}["silent"] == "agent disabled or failed: contributes 0"
    board = spark.createDataFrame([("CL", 5, "naive", 0.0, None, None, False, 0.8, 0.5), ("CL", 5, "ar", 0.04, 0.001, 0.003, True, 0.8, 0.5), ("CL", 5, "auto_select", 0.02, 0.01, 0.02, False, 0.8, 0.5), ("CL", 1, "naive", 0.0, None, None, False, 0.8, 0.5), ("CL", 1, "ar", -0.02, 0.7, 1.0, False, 0.8, 0.5)], "symbol string, horizon int, model string, skill double, dm_p double, dm_p_adj double, edge boolean, coverage double, dir_acc double")
    choice = decisions.chosen(board)
    best = {r.horizon: (r.model, r.edge, r.verdict) for r in choice.collect()}
    assert best[5][:2] == ("ar", True) and "+4.0%" in best[5][2] and "+2.0%" in best[5][2] and best[1][:2] == ("naive", False) and "no measurable edge" in best[1][2]
    forecast = spark.createDataFrame([("CL", h, -0.1, 0.0, 0.1, 0.5) for h in (1, 5)], "symbol string, horizon int, q10 double, q50 double, q90 double, p_up double")
    bands = figures.price_bands(F.col("close"), forecast, spark.createDataFrame([("CL", 100.0)], "symbol string, close double"))
    rows = {r.horizon: r for r in figures.horizon_table(bands, board, choice).collect()}
    assert rows["5d"].p10 == pytest.approx(100 * math.exp(-0.1)) and rows["5d"].model == "ar"
    fan = figures.fan(bars(spark, n=10), bands, F.lit(D(2024, 11, 8)), 3).collect()
    assert [r.at for r in fan if r.kind == "close"] == [D(2024, 11, 6), D(2024, 11, 7), D(2024, 11, 8)] or len([r for r in fan if r.kind == "close"]) == 3
    assert sorted(r.at for r in fan if r.kind == "band") == [D(2024, 11, 11), D(2024, 11, 15)]
    assert [(r.horizon, r.model, r["rank"]) for r in figures.skill_chart(board).filter("horizon = 5").orderBy("rank").collect()][0] == (5, "ar", 1)


def test_settled_skill_and_positions(spark):
    scored = spark.createDataFrame([("CL", 5, m, p, 1.0 if m == "naive" else 0.5 + 0.01 * (p % 3)) for m in ("naive", "ar") for p in range(0, 200, 5)], "symbol string, horizon int, model string, pos long, loss double")
    at = spark.createDataFrame([("CL", 50), ("CL", 150), ("CL", 205)], "symbol string, at long")
    got = {r.at: r for r in decisions.past_skill(scored, at, "ar", 5, 4).collect()}
    assert set(got) == {150, 205} and got[150].scored == 29 and got[205].scored == 40 and got[150].skill > 0.4 and got[150].p < 0.001
    origins = spark.createDataFrame([("CL", p) for p in range(0, 100, 5)], "symbol string, pos long")
    assert sorted(r.pos for r in decisions.decision_positions(origins, 18, 3).collect()) == [40, 60, 80]
    row = spark.range(1).select(*[decisions.settled_signal(F.lit(0.7), F.lit(s), F.lit(p)).alias(n) for n, s, p in (("a", 0.1, 0.01), ("b", 0.1, 0.2), ("c", -0.1, 0.01))]).first()
    assert (row.a, row.b, row.c) == (pytest.approx(0.4), 0.0, 0.0)
    rows = spark.createDataFrame([("x", p, 1.0, 5.0) for p in range(10)], "symbol string, pos long, y_1 double, y_5 double")
    seen = {r.pos: (r.y_1, r.y_5) for r in decisions.until(rows, F.lit(6)).collect()}
    assert max(seen) == 6 and seen[6] == (None, None) and seen[5] == (1.0, None) and seen[1] == (1.0, 5.0)


def test_rebasing_fails_closed(spark):
    rows = bars(spark, n=5)
    start = spark.createDataFrame([("CL", D(2024, 11, 4))], "symbol string, start date")
    got = [r.close for r in decisions.rebased(rows, start).orderBy("date").collect()]
    assert got[1] == 100 and got[0] == pytest.approx(100 * 70.5 / 71.5)
    with pytest.raises(PySparkException):
        decisions.rebased(rows.withColumn("close", -F.col("close")), start).collect()
    models = spark.createDataFrame([("a", D(2024, 11, 4)), ("b", None)], "model string, training_cutoff date")
    assert {r.model: (r.before, r.n) for r in decisions.remembered(models, rows).collect()} == {"a": (2, 5), "b": (5, 5)}


def test_comparison_with_holding(spark):
    rows = bars(spark, n=120).withColumn("roll", F.lit(False)).withColumn("target", F.when(F.col("date") < D(2024, 11, 6), None).when(F.day("date") % 2 == 0, 1.0).otherwise(0.0))
    out = decisions.compare(rows).first()
    window = backtest.first_valid(rows)
    own = backtest.metrics(backtest.run(window)).first()
    assert out.strategy.cagr == own.cagr and out.excess.sharpe == pytest.approx(out.strategy.sharpe - out.benchmark.sharpe) and 0.5 < out.p <= 1
    same = backtest.run(backtest.buy_and_hold(window))
    assert decisions.edge_pvalue(same, same, 10).first().p is None
    assert {r.metric for r in figures.metrics_table(decisions.compare(rows)).collect()} >= {"cagr", "sharpe", "max_drawdown"}
    chart = figures.equity_chart(backtest.run(window), same).orderBy("date").collect()
    assert chart[0].drawdown == 0 and len(chart) == window.count()
    assert "bb_upper" in figures.price_chart(rows).columns
    text = figures.markdown(spark.createDataFrame([("CL", 0.123456789, None, "<b>")], "symbol string, x double, y double, z string"), ["symbol"], "Report")
    assert text.first().text == "# Report CL\n\n- **x**: 0.123457\n- **y**: n/a\n- **z**: <b>"
    assert "<h1>Report CL</h1>" in figures.html(text, ["symbol"]).first().html and "&lt;b&gt;" in figures.html(text, ["symbol"]).first().html


def test_budgets_and_references(spark):
    calls = spark.createDataFrame([("r", k, 0.4, 100, 0.4, 100) for k in range(4)] + [("q", 0, 2.0, 10, 2.0, 10)], "run string, seq int, cost_usd double, tokens long, est_usd double, est_tokens long")
    assert sorted((r.run, r.seq, r.allowed) for r in decisions.charged(calls, 1.0, 1000).collect()) == [("q", 0, False), ("r", 0, True), ("r", 1, True), ("r", 2, False), ("r", 3, False)]
    payloads = spark.createDataFrame([(k, "t", '{"a": {"list": [{"name": "x", "h": 5, "v": 1.5}, {"name": "y.z", "h": 20, "v": -2.0, "flag": true, "word": "up"}]}}') for k in range(8)], "id int, tool string, payload string")
    asked = [(0, "field", "t", "a.list[name=y.z].v", None, None, None, None, None, None), (1, "field", "t", "a.list[h=5].name", None, None, None, None, None, None), (2, "compare", None, None, "t", "a.list[0].v", ">", "t", "a.list[1].v", None), (3, "compare", None, None, "t", "a.list[0].v", "<", None, None, 1.0), (4, "none", None, None, None, None, None, None, None, None), (5, "field", "t", "a.nothing", None, None, None, None, None, None), (6, "field", "t", "a.list[1].flag", None, None, None, None, None, None)]
    questions = spark.createDataFrame(asked, "id int, kind string, tool string, path string, a_tool string, a string, op string, b_tool string, b string, b_value double")
    answers = reports.reference_answers(questions, payloads)
    got = {r.id: (r.value, r.choice) for r in answers.collect()}
    assert got == {0: (-2.0, None), 1: (None, "x"), 2: (None, "yes"), 3: (None, "no"), 4: (None, None), 5: (None, None), 6: (None, "yes")}
    kept = spark.createDataFrame([(0, "number", 1.0, None), (1, "choice", None, "x"), (2, "choice", None, "no"), (4, "unanswerable", None, None)], "id int, type string, expected double, expected_choice string")
    frozen = {r.id: (r.expected, r.expected_choice, r.changed) for r in reports.frozen(kept, answers).collect()}
    assert frozen == {0: (-2.0, None, True), 1: (None, "x", False), 2: (None, "yes", True), 4: (None, None, False)}
    moved = kept.join(answers, "id").select("id", reports.drifted(F.col("type"), F.col("expected"), F.col("expected_choice"), F.col("value"), F.col("choice"), F.lit(0.01)).alias("d"))
    assert {r.id: r.d for r in moved.collect()} == {0: True, 1: False, 2: True, 4: False}


def test_seasons_end_before_the_date(spark):
    monthly = spark.createDataFrame([("x", D(2020, 1, 31), 0.1), ("x", D(2021, 1, 31), 0.3), ("x", D(2022, 1, 31), 9.0)], "symbol string, month_end date, ret double")
    row = fundamentals.month_stats(monthly, F.lit(D(2022, 1, 15))).first()
    assert (row.n, row.mean, row.last_year) == (2, pytest.approx(0.2), 2021)
