"""Settled skill by running sums against gathering every decision's own forecasts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions, evaluate


def test_running_sums_equal_gathering(spark):
    rng = random.Random(8)
    rows = [(s, h, m, p, None if rng.random() < 0.02 else rng.random() * (0.9 if m == "ar" else 1.0)) for s in "ab" for h in (5, 1) for m in ("naive", "ar") for p in sorted(rng.sample(range(900), 160))]
    common = {(s, h): {p for a, b, m, p, _ in rows if (a, b, m) == (s, h, "naive")} & {p for a, b, m, p, _ in rows if (a, b, m) == (s, h, "ar")} for s in "ab" for h in (5, 1)}
    assert all(len(c) > 15 for c in common.values())
    rows += [(s, 5, m, p, rng.random()) for s in "ab" for p in range(1000, 1400, 5) for m in ("naive", "ar")]
    scored = spark.createDataFrame(rows, "symbol string, horizon int, model string, pos long, loss double")
    at = spark.createDataFrame([(s, a) for s in "ab" for a in range(0, 1500, 13)] + [("c", 5)], "symbol string, at long")
    got = {(r.symbol, r["at"]): r for r in decisions.past_skill(scored, at, "ar", 5, 6).collect()}
    base = scored.filter("model = 'naive' and horizon = 5").select("symbol", "pos", F.col("loss").alias("base_loss"))
    pairs = scored.filter("model = 'ar' and horizon = 5").join(base, ["symbol", "pos"])
    settled = at.join(pairs, "symbol").filter("pos + 10 <= at")
    mean = settled.groupBy("symbol", "at").agg(F.count(F.lit(1)).alias("n"), (1 - F.sum("loss") / F.sum("base_loss")).alias("skill"), F.count("loss").alias("known")).filter("n >= 20")
    tested = evaluate.block_test(settled.select("symbol", "at", "pos", (F.col("loss") - F.col("base_loss")).alias("d")), ["symbol", "at"], 6)
    want = mean.join(tested.select("symbol", "at", "p"), ["symbol", "at"], "left").collect()
    assert len(want) == len(got) > 100 and {r.n < 24 for r in want} == {True, False}
    for r in want:
        mine = got[(r.symbol, r["at"])]
        assert mine.scored == r.n and mine.p == (None if r.p is None else pytest.approx(r.p, abs=1e-9)) and (r.skill is None or mine.skill == pytest.approx(r.skill, abs=1e-9))
