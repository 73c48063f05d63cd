"""Likelihoods against dense normal densities, searches on planted processes, forecasts by simulation."""

import math

import numpy as np
import pytest

from tidemark.operators import evaluate, statespace

RNG = np.random.default_rng(11)


def autocovariance(phi, theta, n):
    psi = [1.0]
    for k in range(1, 4000):
        psi.append(sum(p * psi[k - 1 - j] for j, p in enumerate(phi) if k - 1 - j >= 0) + (theta[k - 1] if k <= len(theta) else 0.0))
    psi = np.array(psi)
    return np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])


@pytest.mark.parametrize(("phi", "theta"), [((0.0, 0.0), (0.0, 0.0)), ((0.6, 0.2), (0.0, 0.0)), ((0.0, 0.0), (0.5, -0.3)), ((1.2, -0.4), (0.4, 0.1)), ((-0.5, 0.0), (0.9, 0.0))])
def test_likelihood_is_that_of_a_dense_normal(phi, theta):
    w = RNG.normal(size=40) * 1.7
    gamma = autocovariance(phi, theta, 40)
    cov = gamma[np.abs(np.subtract.outer(np.arange(40), np.arange(40)))]
    quad, (_, logdet) = w @ np.linalg.solve(cov, w), np.linalg.slogdet(cov)
    s2 = quad / 40
    want = -0.5 * (40 * (math.log(2 * math.pi * s2) + 1) + logdet)
    got, sigma2, _ = statespace.filtered(w, np.array([phi, (0.1, 0.1)]), np.array([theta, (0.0, 0.2)]))
    assert got[0] == pytest.approx(want, abs=1e-7) and sigma2[0] == pytest.approx(s2, rel=1e-8)


def process(phi, theta, n, seed):
    e = np.random.default_rng(seed).normal(size=n + 200)
    y = np.zeros(n + 200)
    for k in range(2, n + 200):
        y[k] = phi[0] * y[k - 1] + phi[1] * y[k - 2] + e[k] + theta[0] * e[k - 1] + theta[1] * e[k - 2]
    return y[200:]


def test_search_finds_planted_orders():
    ar = process((0.5, -0.3), (0, 0), 3000, 1)
    walk = np.cumsum(ar * 0.01)
    model = statespace.fit_arima(walk)
    assert model.d == 1 and model.phi == pytest.approx((0.5, -0.3), abs=0.2) and math.sqrt(model.sigma2) == pytest.approx(0.01, rel=0.05)
    ma = statespace.fit_arima(np.cumsum(process((0, 0), (-0.6, 0), 3000, 2)))
    lag = ma.phi[0] + ma.theta[0]  # the first weight of the moving average form
    assert ma.d == 1 and lag == pytest.approx(-0.6, abs=0.06)
    noise = statespace.fit_arima(np.cumsum(np.random.default_rng(3).normal(size=2000)))
    assert noise.d == 1 and abs(noise.phi).max() < 0.2 and statespace.differences(np.random.default_rng(4).normal(size=500)) == 0


def test_likelihood_cannot_be_bettered_nearby():
    w = process((0.4, 0.0), (0.3, 0.0), 800, 5)
    free = np.array([[True, False, True, False]])
    score = lambda rows: statespace.filtered(w, *statespace.coefficients(rows))[0]
    x = statespace.climbed(score, np.full((1, 4), 0.05) * free, free)
    grid = x + np.array([[a, 0, b, 0] for a in np.linspace(-0.3, 0.3, 7) for b in np.linspace(-0.3, 0.3, 7)])
    assert score(x)[0] >= score(grid).max() - 1e-3


@pytest.mark.parametrize("d", [0, 1, 2])
def test_arima_paths_by_simulation(d):
    model = statespace.Arima(d, np.array([0.5, -0.2]), np.array([0.3, 0.0]), 0.1 if d < 2 else 0.0, 0.25, 0.0)
    w = process((0.5, -0.2), (0.3, 0), 300, 6) * 0.5 + model.mean
    y = w.copy()
    for _ in range(d):
        y = np.cumsum(y)
    mean, deviation = statespace.arima_paths(y, model, np.array([250, 299]), (1, 5))
    rng, n = np.random.default_rng(7), 40_000
    e = [0.0, 0.0]
    for k in range(2, 300):  # the shocks, once the start is forgotten
        e.append((w[k] - model.mean) - 0.5 * (w[k - 1] - model.mean) + 0.2 * (w[k - 2] - model.mean) - 0.3 * e[-1])
    last, before, shock = np.full(n, w[-1] - model.mean), np.full(n, w[-2] - model.mean), np.full(n, e[-1])
    levels = [np.full(n, np.diff(y, n=k)[-1]) for k in range(d)]
    for h in range(1, 6):
        new = rng.normal(size=n) * 0.5
        last, before, shock = 0.5 * last - 0.2 * before + new + 0.3 * shock, last, new
        x = last + model.mean
        for k in range(d - 1, -1, -1):
            levels[k] = levels[k] + x
            x = levels[k]
        if h in (1, 5):
            i = (1, 5).index(h)
            assert mean[1, i] == pytest.approx((x - y[-1]).mean(), abs=0.06 * (1 + 4 * d)) and deviation[1, i] == pytest.approx((x - y[-1]).std(), rel=0.03)


def test_smoothing():
    y = np.cumsum(np.random.default_rng(8).normal(size=1500)) + 50
    model = statespace.fit_ets(y)
    assert model.alpha > 0.9 and model.sigma2 == pytest.approx(1, rel=0.1)
    trend = 0.5 * np.arange(400) + np.random.default_rng(9).normal(size=400)
    grown = statespace.fit_ets(trend)
    mean, deviation = statespace.ets_paths(trend, grown, np.array([300, 399]), (1, 10))
    level = trend[399] + mean[1]
    assert grown.damp > 0.8 and level == pytest.approx([200, 204.5], abs=1.5) and deviation[0, 1] >= deviation[0, 0] > 0
    flat = statespace.fit_ets(np.random.default_rng(10).normal(size=500))
    assert flat.alpha < 0.1


def test_groups_look_ahead_from_each_origin(spark):
    r = np.random.default_rng(12).normal(size=400) * 0.01
    rows = spark.createDataFrame([("s", k, None if k % 50 == 7 else float(x)) for k, x in enumerate(r)], "symbol string, pos long, ret double")
    folds = spark.createDataFrame([("s", f, 299 + 20 * f, 310 + 20 * f + k) for f in range(4) for k in (0, 5)], "symbol string, fold int, train_end long, pos long")
    got = statespace.searched(folds, rows, (1, 5), evaluate.QUANTILES).collect()
    assert len(got) == 2 * 2 * 8 and all(g.q10 < g.q50 < g.q90 and 0 < g.p_up < 1 for g in got)
    part = rows.filter("pos <= 335")  # what comes later changes nothing
    again = statespace.searched(folds.filter("fold < 2"), part, (1, 5), evaluate.QUANTILES).collect()
    key = lambda g: (g.model, g.horizon, g.pos)
    first = {key(g): g.q90 for g in got}
    assert again and all(first[key(g)] == pytest.approx(g.q90, rel=1e-9) for g in again)
    assert statespace.searched(folds, rows.filter("pos < 50"), (1,), evaluate.QUANTILES).collect() == []
