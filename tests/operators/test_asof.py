"""As-of joins in buckets of time against a search through all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit

START = dt.datetime(1969, 6, 1)
LEFT, RIGHT = "k string, t timestamp_ntz, n int", "k string, at timestamp_ntz, period int, v string"


def tables(seed, n_left, n_right):
    rng = random.Random(seed)
    at = lambda: rng.choice([None, START + dt.timedelta(days=rng.choice([rng.randrange(900), rng.randrange(9000)]), hours=rng.randrange(3))]) if rng.random() < 0.1 else START + dt.timedelta(days=rng.randrange(700), hours=rng.randrange(2))
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(key(), at(), i) for i in range(n_left)]
    right = [(key(), at(), i // 2 * 7 % 101, f"v{i // 2 * 7 % 101}") for i in range(n_right)]
    return left, right


def brute(left, right, keyed, greatest):
    out = []
    for k, t, n in left:
        public = [r for r in right if t is not None and r[1] is not None and r[1] <= t and (not keyed or r[0] == k)]
        best = max(public, key=lambda r: (r[2],) if greatest else (r[1], r[2]), default=None)
        out.append((n, best and best[2], best and best[3]))
    return sorted(out)


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("order_by", ["release", "period"])
def test_backward(spark, keyed, order_by):
    left, right = tables(keyed, 300, 240)
    a, b = spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(5)
    got = pit.as_of_join(a, b, "t", "at", ["period", "v"], ("k",) if keyed else (), "period", order_by)
    assert sorted((r.n, r.period, r.v) for r in got.collect()) == brute(left, right, keyed, order_by == "period")
    assert [c for c in got.columns] == ["k", "t", "n", "period", "v"]


@pytest.mark.parametrize("strict", [True, False])
def test_forward(spark, strict):
    rng = random.Random(5)
    day = lambda: dt.date(1969, 1, 1) + dt.timedelta(days=rng.randrange(2000))
    left, right = [(i, day()) for i in range(200)] + [(200, None)], [day() for _ in range(40)]
    got = pit.next_after(spark.createDataFrame(left, "i int, d date"), spark.createDataFrame([(d,) for d in right], "e date"), "d", "e", "n", strict)
    later = lambda d: min((e for e in right if d and (e > d if strict else e >= d)), default=None)
    assert sorted((r.i, r.n) for r in got.collect()) == [(i, later(d)) for i, d in left]


def test_no_single_task(spark):
    left, right = tables(1, 20, 20)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    plans = [pit.as_of_join(a, b, "t", "at", ["v"], tie="period"), pit.next_after(a.select(F.to_date("t").alias("d")), b.select(F.to_date("at").alias("e")), "d", "e", "n")]
    assert all("SinglePartition" not in p._jdf.queryExecution().toString() for p in plans)
    assert pit.as_of_join(a.limit(0), b, "t", "at", ["v"]).collect() == []
    assert all(r.v is None for r in pit.as_of_join(a, b.limit(0), "t", "at", ["v"]).collect())
