import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import reports

D = dt.date


def test_significant_digits_and_weekdays(spark):
    rows = spark.createDataFrame([(123456.789,), (-0.00123456,), (0.0,), (float("inf"),), (None,)], "x double")
    assert [r.y for r in rows.select(reports.significant(F.col("x"), 3).alias("y")).collect()] == [123000.0, -0.00123, 0.0, None, None]
    days = [D(2026, 1, 1) + dt.timedelta(k) for k in range(14)]
    for n in (1, 5, 20):
        for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", reports.weekdays_after(F.col("d"), n).alias("e")).collect():
            at, left = r.d, n
            while left:
                at += dt.timedelta(1)
                left -= at.weekday() < 5
            assert r.e == at


def test_listing_skips_malformed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"symbol": "CL", "n": 1}))
    (tmp_path / "b.json").write_text("{ not json")
    assert [(r.name, r.symbol) for r in reports.listing(spark, f"file://{tmp_path}/*.json", "symbol string, n int").collect()] == [("a", "CL")]


def test_run_summaries_and_costs(spark, tmp_path):
    lines = [{"seq": 1, "kind": "llm", "agent": "a", "cost": 0.5, "tokens": 10}, {"seq": 2, "kind": "tool", "error": "x"}, {"seq": 3, "kind": "llm", "agent": "b", "cost": 0.75, "rating": "buy"}]
    (tmp_path / "r1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    log = reports.events(spark, f"file://{tmp_path}/*.jsonl")
    assert tuple(reports.run_summaries(log).first()) == ("r1", 2, 1, 1, 1.25, 10, "buy")
    assert [tuple(r) for r in reports.cost_by_agent(log).collect()] == [("b", 0.75), ("a", 0.5)]
    usage = spark.createDataFrame([("m", 1_000_000, 2, 0, 0)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    prices = spark.createDataFrame([("m", 3.0, 15.0, 0.3, 3.75)], "model string, input_price double, output_price double, cache_read_price double, cache_write_price double")
    assert abs(reports.cost_usd(usage, prices).first().cost - 3.00003) < 1e-9


def test_scoring(spark):
    rows = [
        (1, "number", 91.5, 91.4999, False, None, None, None, ["x"]), (2, "number", 0.023, 2.3, True, None, None, None, ["x"]), (3, "number", 5.0, 5.2, False, None, None, None, ["x"]),
        (4, "choice", None, None, False, None, "contango", "It is Contango.", ["contango", "backwardation"]), (5, "choice", None, None, False, None, "contango", "contango or backwardation", ["contango", "backwardation"]),
        (6, "none", None, None, False, None, None, None, ["x"]), (7, "none", None, 1.0, False, None, None, None, ["x"]),
    ]
    frame = spark.createDataFrame(rows, "id int, type string, expected double, value double, percent boolean, tol double, option string, text string, options array<string>")
    assert {r.id: r.correct for r in reports.score(frame).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False}


def test_curve_ends_at_the_first_gap(spark):
    e = [D(2026, m, 20) for m in (2, 3, 4, 5)]
    rows = [("CL", e[0], D(2026, 1, 9), 70.0), ("CL", e[0], D(2026, 1, 12), 71.0), ("CL", e[1], D(2026, 1, 12), 72.0), ("CL", e[2], None, None), ("CL", e[3], D(2026, 1, 12), 74.0)]
    got = reports.contiguous_curve(spark.createDataFrame(rows, "symbol string, expiry date, date date, settle double"), F.lit(D(2026, 1, 12)), 4).orderBy("expiry").collect()
    assert [(r.expiry, r.settle) for r in got] == [(e[0], 71.0), (e[1], 72.0)]


def test_summary_and_sink(spark, tmp_path):
    boards = spark.createDataFrame([("e", 5, "naive", 0.0, False), ("e", 5, "ar", 0.1, True), ("e", 5, "ses", 0.2, False), ("e", 5, "auto_select", 0.9, False)], "evaluation string, horizon int, model string, skill double, edge boolean")
    assert tuple(reports.leaderboard_summary(boards).first()) == ("e", 5, "ses", 0.2, True)
    reports.save_curves(spark.createDataFrame([(D(2026, 1, 1), 1.23456789012)], "date date, equity double"), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").first().equity == "1.2345679"
