"""Boosted trees against exhaustive search and on planted data."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boost, evaluate

SCHEMA = "model string, alpha double, bins array<int>, y double"


def planted(n, seed, noise=0.3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("s", k, a, None if k % 17 == 0 else b, c, (1.0 if a > 0.3 else -1.0) + (0.5 if (b > 0) else 0.0) + rng.gauss(0, noise)))
    return rows


def test_bins_are_quantiles(spark):
    rows = spark.createDataFrame([(float(v), None if v % 2 else float("nan")) for v in range(1, 101)] + [(None, 3.0)], "a double, b double")
    cuts = boost.edges(rows, ["a", "b"], 4)
    assert cuts.first().edges == [[25.0, 50.0, 75.0], [3.0]]
    got = [r.bins for r in boost.binned(spark.createDataFrame([(25.0, 3.0), (25.5, 4.0), (101.0, None), (None, float("nan"))], "a double, b double"), cuts, ["a", "b"]).collect()]
    assert got == [[1, 1], [2, 2], [4, 0], [0, 0]]


@pytest.mark.parametrize("alpha", [0.1, 0.5, None])
def test_first_split_is_the_best_of_all(spark, alpha):
    rng = random.Random(4)
    rows = [("m", alpha, [rng.randrange(6), rng.randrange(4)], float(rng.random() < 0.4) if alpha is None else rng.gauss(0, 1)) for _ in range(300)]
    state = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"pred": F.lit(0.1), "node": F.lit(1)})
    got = boost.best_splits(boost.histograms(boost.gradients(state)), 1.0, 20).collect()

    def derivatives(y):
        if alpha is None:
            p = 1 / (1 + 2.718281828459045**-0.1)
            return p - y, p * (1 - p)
        return (1 - alpha if y < 0.1 else -alpha), 1.0

    def score(part):
        g, h = (sum(derivatives(r[3])[k] for r in part) for k in (0, 1))
        return g * g / (h + 1.0)

    best = max(
        (round(score(left) + score(right) - score(rows), 9), -f, -b)
        for f in (0, 1)
        for b in range(6)
        for left, right in [([r for r in rows if r[2][f] <= b], [r for r in rows if r[2][f] > b])]
        if min(len(left), len(right)) >= 20
    )
    assert [(r.feature, r.bin) for r in got] == [(-best[1], -best[2])] and got[0].gain == pytest.approx(best[0])


def test_trees_predict_as_they_were_grown(spark):
    rng = random.Random(7)
    s = boost.Settings(trees=3, depth=2, rate=0.5, least_rows=5)
    rows = [(m, a, [rng.randrange(5), rng.randrange(3)], rng.gauss(0, 1) if a else float(rng.random() < 0.3)) for m, a in (("u", 0.5), ("v", 0.9), ("w", None)) for _ in range(120)]
    table = spark.createDataFrame([*rows, ("x", 0.5, [1, 1], None)], SCHEMA)
    models = boost.train(table, (0.5, 0.9), s)
    got = {(r.model, tuple(r.bins)): r.score for r in boost.predicted(models, table.select("model", "bins").distinct(), s).collect()}
    for m in models.collect():
        assert m.model in "uvw" and len(m.trees) == 3
        for _, _, bins, _ in (r for r in rows if r[0] == m.model):
            total = m.base
            for tree in m.trees:
                node = 1
                for _ in range(2):
                    cut = (tree.splits or {}).get(node)
                    node = 2 * node + (cut is not None and bins[cut.feature] > cut.bin)
                total += 0.5 * tree.leaves[node]
            assert got[(m.model, tuple(bins))] == pytest.approx(total)
    assert not any(k[0] == "x" for k in got)


def test_planted_rules_are_found(spark):
    names, horizon = ["a", "b", "c"], 1
    rows = spark.createDataFrame(planted(900, 1), "symbol string, pos long, a double, b double, c double, y double")
    folds = spark.createDataFrame([("s", f, 599 + 100 * (f // 2), p) for f in range(4) for p in range(610 + 60 * f, 660 + 60 * f, 5)], "symbol string, fold int, train_end long, pos long")
    out, models = boost.forecasts(rows, folds, names, horizon, evaluate.QUANTILES, refit_every=2, settings=boost.Settings(trees=12, depth=2, rate=0.3))
    met = out.join(rows, ["symbol", "pos"]).collect()
    assert len(met) == folds.count() and all(r.q10 <= r.q50 <= r.q90 for r in met)
    loss = lambda q: sum(max(a * (r.y - q(r)[k]), (a - 1) * (r.y - q(r)[k])) for r in met for k, a in enumerate((0.1, 0.5, 0.9)))
    ys = sorted(r[5] for r in planted(900, 1)[:600])
    flat = [ys[int(len(ys) * a)] for a in (0.1, 0.5, 0.9)]
    assert loss(lambda r: (r.q10, r.q50, r.q90)) < 0.6 * loss(lambda r: flat)
    assert sum((r.p_up > 0.5) == (r.y > 0) for r in met) > 0.85 * len(met)
    gain = {r.feature: r.gain for r in boost.importance(models, names).groupBy("feature").agg(F.sum("gain").alias("gain")).collect()}
    assert gain["a"] > gain["b"] > gain.get("c", 0)


def test_shares_of_rows_and_features_and_no_rows(spark):
    table = spark.createDataFrame([("m", 0.5, [k % 3, k % 2], float(k % 3)) for k in range(90)], SCHEMA)
    s = boost.Settings(trees=2, depth=1, subsample=0.7, colsample=0.5)
    first, second = (sorted(map(str, boost.train(table, (0.5,), s).collect())) for _ in range(2))
    assert first == second
    assert boost.train(table.limit(0), (0.5,), s).collect() == []
