"""ARIMA and exponential smoothing by their likelihoods, many candidates in one recursion.

An ARMA(p, q) process stands in state space; its exact Gaussian likelihood is
that of a Kalman filter begun at the stationary state. All orders, and all
points at which a search asks for them, are rows of one batch, so a step of the
recursion is a few numpy operations for all of them. Orders are ranked by AICc.

A model is fitted for a symbol and a run of folds; at each origin its filter has
seen the data up to there, so the state is the one known then.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = tuple((p, q) for p in range(3) for q in range(3))
STATES = 3
#: Fixed value: the 5 % point of the level-stationarity statistic.
KPSS_5 = 0.463


class Arima(NamedTuple):
    d: int
    phi: np.ndarray
    theta: np.ndarray
    mean: float
    sigma2: float
    aicc: float


class Ets(NamedTuple):
    alpha: float
    beta: float
    damp: float
    level: float
    slope: float
    sigma2: float
    aicc: float


def kpss(y: np.ndarray) -> float:
    """The statistic of level stationarity, with a Bartlett window of 4 (n / 100) ** 0.25 lags."""
    e = y - y.mean()
    lags = int(4 * (len(y) / 100) ** 0.25)
    long_run = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (len(y) * max(long_run, 1e-300)))


def differences(y: np.ndarray, most: int = 2) -> int:
    """How often y must be differenced to pass as stationary."""
    d = 0
    while d < most and len(y) > 20 and y.std() > 0 and kpss(y) > KPSS_5:
        y, d = np.diff(y), d + 1
    return d


def from_partial(r: np.ndarray) -> np.ndarray:
    """Stable coefficients (rows of two) from partial autocorrelations in (-1, 1)."""
    return np.stack([r[:, 0] * (1 - r[:, 1]), r[:, 1]], axis=1)


def filtered(w: np.ndarray, phi: np.ndarray, theta: np.ndarray, keep: bool = False):
    """Concentrated log likelihood of w for each row of coefficients (each padded to two), and the variance.

    With keep, also the one-step states behind every value, for forecasts. The
    covariance is followed until it no longer moves; from then on the gain is fixed.
    """
    n, m = len(w), len(phi)
    t = np.zeros((m, STATES, STATES))
    t[:, :2, 0] = phi
    t[:, 0, 1] = t[:, 1, 2] = 1
    turned, r = t.transpose(0, 2, 1).copy(), np.concatenate([np.ones((m, 1)), theta], axis=1)
    rr = r[:, :, None] * r[:, None, :]
    big = np.eye(9) - np.einsum("bij,bkl->bikjl", t, t).reshape(m, 9, 9)
    cov = np.linalg.solve(big, rr.reshape(m, 9, 1)).reshape(m, 3, 3)
    a, total, logs = np.zeros((m, STATES)), np.zeros(m), np.zeros(m)
    states, gain, f, still = np.empty((n, m, STATES)) if keep else None, None, None, False
    for k in range(n):
        if not still:
            f = cov[:, 0, 0]
            through = t @ cov
            gain = through[:, :, 0] / f[:, None]
            after = through @ turned + rr - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
            still = k > 3 and float(np.abs(after - cov).max()) < 1e-11
            cov, lf = after, np.log(f)
        v = w[k] - a[:, 0]
        total += v * v / f
        logs += lf
        pushed = gain * v[:, None]
        pushed[:, :2] += phi * a[:, :1] + a[:, 1:]
        a = pushed
        if keep:
            states[k] = a
    sigma2 = np.maximum(total / n, 1e-300)
    return -0.5 * (n * (np.log(2 * math.pi * sigma2) + 1) + logs), sigma2, states


def climbed(score: Callable[[np.ndarray], np.ndarray], start: np.ndarray, free: np.ndarray, rounds: int = 12, step: float = 1e-4) -> np.ndarray:
    """Rows of parameters that maximise score, which takes many rows at once: quasi-Newton steps of all rows together.

    free marks the parameters of a row that may move. A round asks for the
    gradients of all rows in one call and for six lengths of step in another.
    """
    x, (m, n) = start.copy(), start.shape
    inverse = np.repeat(np.eye(n)[None] * 0.5 / 100, m, axis=0)
    value, old_x, old_g = score(x), None, None
    lengths = np.array([0.1, 0.3, 1.0, 2.0, 5.0, 20.0])
    for _ in range(rounds):
        shifts = np.concatenate([x[:, None] + s * step * np.eye(n)[None] for s in (1, -1)], axis=1).reshape(-1, n)
        both = score(shifts).reshape(m, 2, n)
        g = np.where(free, (both[:, 0] - both[:, 1]) / (2 * step), 0.0)
        if old_g is not None:
            s, y = x - old_x, old_g - g
            sy = np.einsum("bi,bi->b", s, y)
            for b in np.flatnonzero(sy > 1e-10):
                left = np.eye(n) - np.outer(s[b], y[b]) / sy[b]
                inverse[b] = left @ inverse[b] @ left.T + np.outer(s[b], s[b]) / sy[b]
        way = np.where(free, np.einsum("bij,bj->bi", inverse, g), 0.0)
        way = np.clip(way, -1, 1)
        tried = (x[:, None] + lengths[None, :, None] * way[:, None]).reshape(-1, n)
        found = score(tried).reshape(m, -1)
        found = np.where(np.isfinite(found), found, -np.inf)
        best = found.argmax(axis=1)
        better = found[np.arange(m), best] > value
        old_x, old_g = x.copy(), g
        x = np.where(better[:, None], x + lengths[best][:, None] * way, x)
        gained = np.where(better, found[np.arange(m), best] - value, 0.0)
        value = np.where(better, found[np.arange(m), best], value)
        if gained.max() < 1e-5:
            break
    return x


def coefficients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi and theta of rows of four free numbers; both stable."""
    r = np.tanh(x) * 0.995
    return from_partial(r[:, :2]), -from_partial(-r[:, 2:])


def aicc(loglik: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    return -2 * loglik + 2 * k * n / np.maximum(n - k - 1, 1)


def fit_arima(y: np.ndarray, orders: tuple[tuple[int, int], ...] = ORDERS, most_d: int = 2) -> Arima:
    """The order of least AICc; d by the stationarity test, with and without a mean of the differences up to d = 1."""
    d = differences(y, most_d)
    w = np.diff(y, n=d) if d else y
    scale = float(w.std()) or 1.0
    means = (0.0, float(w.mean())) if d < 2 else (0.0,)
    best = None
    for mean in means if d else means[1:]:
        z = (w - mean) / scale
        free = np.array([[p > 0, p > 1, q > 0, q > 1] for p, q in orders])
        x = climbed(lambda rows: filtered(z, *coefficients(rows))[0], np.where(free, 0.05, 0.0), free)
        loglik, sigma2, _ = filtered(z, *coefficients(x))
        score = aicc(loglik, free.sum(axis=1) + 1 + (mean != 0), len(z))
        k = int(score.argmin())
        phi, theta = coefficients(x)
        if best is None or score[k] < best.aicc:
            best = Arima(d, phi[k], theta[k], mean, float(sigma2[k]) * scale**2, float(score[k]))
    return best


def arima_paths(y: np.ndarray, model: Arima, origins: np.ndarray, horizons: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of y[p + h] - y[p] for each origin p and horizon h."""
    d = model.d
    w = (np.diff(y, n=d) if d else y) - model.mean
    _, _, states = filtered(w, model.phi[None], model.theta[None], keep=True)
    most = max(horizons)
    t = np.zeros((STATES, STATES))
    t[:2, 0], t[0, 1], t[1, 2] = model.phi, 1, 1
    psi, row = [1.0], np.array([1.0, *model.theta])
    for _ in range(1, most):
        row = t @ row
        psi.append(float(row[0]))
    for _ in range(d):
        psi = np.cumsum(psi)
    out = np.empty((len(origins), len(horizons)))
    for i, p in enumerate(origins):
        a, ahead = states[p - d, 0], []
        for _ in range(most):
            ahead.append(float(a[0]) + model.mean)
            a = t @ a
        path = np.array(ahead)
        for k in range(d, 0, -1):  # undo one difference after the other, from the last one known
            base = np.diff(y[: p + 1], n=k - 1)[-1] if k > 1 else y[p]
            path = base + np.cumsum(path)
        out[i] = path[np.array(horizons) - 1] - y[p]
    deviation = np.sqrt(model.sigma2 * np.cumsum(np.square(psi)))
    return out, np.repeat(deviation[np.array(horizons) - 1][None], len(origins), axis=0)


KINDS = ("level", "slope", "damped")


def smoothed(y: np.ndarray, x: np.ndarray, kind: np.ndarray, keep: bool = False):
    """The squared errors of exponential smoothing for rows of free numbers, and the weights; with keep also (level, slope) behind every value.

    kind: 0 a level, 1 with a slope, 2 with a damped slope.
    """
    share = 1 / (1 + np.exp(-x))
    alpha = 1e-4 + (1 - 2e-4) * share[:, 0]
    beta = np.where(kind > 0, (1e-4 + (1 - 2e-4) * share[:, 1]) * alpha, 0.0)
    damp = np.where(kind == 2, 0.8 + 0.18 * share[:, 2], np.where(kind == 1, 1.0, 0.0))
    level, slope = np.full(len(x), y[0]), np.where(kind > 0, np.diff(y[:11]).mean(), 0.0)
    total, states = np.zeros(len(x)), np.empty((len(y), len(x), 2)) if keep else None
    for k in range(len(y)):
        ahead = level + damp * slope
        e = y[k] - ahead
        total += e * e
        level, slope = ahead + alpha * e, damp * slope + beta * e
        if keep:
            states[k, :, 0], states[k, :, 1] = level, slope
    return total, (alpha, beta, damp), states


def fit_ets(y: np.ndarray) -> Ets:
    """The kind of least AICc with additive errors and no season: a level, a slope, a damped slope."""
    kind, n = np.arange(3), len(y)
    starts = np.array([[1.0, -2.0, 1.0], [2.0, -4.0, 1.0], [2.0, -3.0, 1.0]])
    free = np.array([[True, k > 0, k > 1] for k in kind])

    def score(rows: np.ndarray) -> np.ndarray:
        of = np.repeat(kind, len(rows) // 3)
        return -0.5 * n * np.log(np.maximum(smoothed(y, rows, of)[0], 1e-300) / n)

    x = climbed(score, starts, free)
    total, (alpha, beta, damp), _ = smoothed(y, x, kind)
    k = np.array([3, 5, 6])  # weights, first states and the variance
    loglik = -0.5 * n * (np.log(2 * math.pi * np.maximum(total, 1e-300) / n) + 1)
    value = aicc(loglik, k, n)
    b = int(value.argmin())
    _, _, states = smoothed(y, x[b : b + 1], kind[b : b + 1], keep=True)
    return Ets(float(alpha[b]), float(beta[b]), float(damp[b]), float(states[0, 0, 0]), float(states[0, 0, 1]), float(total[b]) / n, float(value[b]))


def ets_paths(y: np.ndarray, model: Ets, origins: np.ndarray, horizons: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of y[p + h] - y[p] from the smoothed state at each origin."""
    level, slope = model.level, model.slope
    held = np.empty((len(y), 2))
    held[0] = level, slope
    for k in range(1, len(y)):
        ahead = level + model.damp * slope
        e = y[k] - ahead
        level, slope = ahead + model.alpha * e, model.damp * slope + model.beta * e
        held[k] = level, slope
    powers = np.cumsum(model.damp ** np.arange(1, max(horizons) + 1))
    weight = np.r_[1.0, model.alpha + model.beta * powers[:-1]]
    deviation = np.sqrt(model.sigma2 * np.cumsum(weight**2))
    at = np.array(horizons) - 1
    mean = held[origins, :1] + held[origins, 1:] * powers[at][None] - y[origins][:, None]
    return mean, np.repeat(deviation[at][None], len(origins), axis=0)


def searched(folds: DataFrame, returns: DataFrame, horizons: tuple[int, ...], quantiles: dict[str, float], refit_every: int = 3, least: int = 100) -> DataFrame:
    """arima and ets predictions (symbol, model, horizon, fold, pos, quantiles, p_up) at the origins of folds.

    One group is a symbol and refit_every folds: models are fitted to the rows
    up to the first one's train_end, on the running sum of returns (null ones as
    zero), and looked ahead from each origin. Fewer than `least` rows give none.
    """
    from statistics import NormalDist

    runs = folds.withColumn("g", F.floor(F.col("fold") / refit_every))
    ends = runs.groupBy("symbol", "g").agg(F.min("train_end").alias("cut"), F.max("pos").alias("last"), F.array_sort(F.collect_list(F.struct("pos", "fold"))).alias("origins"))
    own = ends.join(returns.select("symbol", "pos", "ret"), "symbol").filter("pos <= last")
    columns = ["symbol", "model", "horizon", "fold", "pos", *quantiles, "p_up"]
    z = {c: NormalDist().inv_cdf(q) for c, q in quantiles.items()}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        y, first = group["ret"].fillna(0.0).to_numpy(float).cumsum(), int(group["pos"].iloc[0])
        known = y[: int(group["cut"].iloc[0]) - first + 1]
        origins = [(int(o["pos"]), int(o["fold"])) for o in group["origins"].iloc[0]]
        if len(known) < least:
            return pd.DataFrame(columns=columns)
        at, rows = np.array([p - first for p, _ in origins]), []
        for name, (mean, deviation) in (("arima", arima_paths(y, fit_arima(known), at, horizons)), ("ets", ets_paths(y, fit_ets(known), at, horizons))):
            for i, (p, fold) in enumerate(origins):
                for k, h in enumerate(horizons):
                    m, s = float(mean[i, k]), float(deviation[i, k])
                    up = 0.5 * math.erfc(-m / s / math.sqrt(2)) if s > 0 else 0.5
                    rows.append((group["symbol"].iloc[0], name, h, fold, p, *(m + q * s for q in z.values()), up))
        return pd.DataFrame(rows, columns=columns)

    types = ", ".join(f"{c} double" for c in quantiles)
    return own.groupBy("symbol", "g").applyInPandas(run, f"symbol string, model string, horizon int, fold int, pos bigint, {types}, p_up double")
