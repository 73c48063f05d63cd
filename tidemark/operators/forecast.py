"""Forecast models and the walk-forward run that scores them.

Rolling quantiles are joins of origins to their own frames. Autoregression
and exponential smoothing are fitted per (fold, symbol) in grouped pandas; the
search over ARIMA and ETS is in `statespace`, boosted trees in `boost`.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.written import Written

from . import boost, evaluate, statespace
from .evaluate import QUANTILES, Plan

Z = {c: NormalDist().inv_cdf(q) for c, q in QUANTILES.items()}


def fit_ar(r: np.ndarray, orders: tuple[int, ...] = (0, 1, 2)) -> tuple[float, np.ndarray, float]:
    """(constant, coefficients, sigma) of the order of least AIC by least squares."""
    best = None
    for p in orders:
        x = np.column_stack([np.ones(len(r) - 2), *(r[2 - k : len(r) - k] for k in range(1, p + 1))])
        b, *_ = np.linalg.lstsq(x, r[2:], rcond=None)
        s2 = float(np.mean((r[2:] - x @ b) ** 2))
        aic = len(r) * math.log(max(s2, 1e-300)) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, float(b[0]), b[1:], math.sqrt(s2))
    return best[1:]


def ar_path(r: np.ndarray, const: float, coef: np.ndarray, sigma: float, h: int) -> tuple[float, float]:
    """Mean and deviation of the sum of the next h returns."""
    history, mean = list(r[-2:]), 0.0
    for _ in range(h):
        step = const + sum(c * history[-1 - k] for k, c in enumerate(coef))
        history.append(step)
        mean += step
    psi = [1.0]
    for k in range(1, h):
        psi.append(sum(c * psi[k - 1 - j] for j, c in enumerate(coef) if k - 1 - j >= 0))
    return mean, sigma * math.sqrt(sum(x * x for x in np.cumsum(psi)))


def smooth(frames: np.ndarray, alphas: np.ndarray = np.linspace(0.02, 0.6, 12)) -> list[tuple[float, float]]:
    """Level and deviation of simple exponential smoothing of each row of frames, alpha by the least squared error; rows and alphas in one recursion."""
    level = np.repeat(frames[:, :20].mean(axis=1)[:, None], len(alphas), axis=1)
    loss = np.zeros_like(level)
    for x in frames[:, 20:].T:
        error = x[:, None] - level
        loss += error * error
        level += alphas * error
    best, row = loss.argmin(axis=1), np.arange(len(frames))
    return list(zip(level[row, best].tolist(), np.sqrt(loss[row, best] / max(1, frames.shape[1] - 20)).tolist(), strict=True))


def statistical(folds: DataFrame, returns: DataFrame, horizons: tuple[int, ...], lookback: int = 756) -> DataFrame:
    """ar and ses predictions (symbol, model, horizon, fold, pos, quantiles, p_up): one group a symbol and fold, each with the rows up to its last origin.

    A row goes to the folds whose frame holds it, by buckets of lookback.
    """
    ends = folds.groupBy("symbol", "fold", "train_end").agg(F.max("pos").alias("last"), F.array_sort(F.collect_set("pos")).alias("origins"))
    bucket = lambda c: F.floor(F.col(c) / lookback)
    ends = ends.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("train_end") - lookback) / lookback), bucket("last"))))
    own = ends.join(returns.select("symbol", "pos", "ret", bucket("pos").alias("bucket")), ["symbol", "bucket"]).drop("bucket").filter((F.col("pos") <= F.col("last")) & (F.col("pos") > F.col("train_end") - lookback))
    columns = ["symbol", "model", "horizon", "fold", "pos", *QUANTILES, "p_up"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        train_end, rows = int(group["train_end"].iloc[0]), []
        train = group.loc[group["pos"] <= train_end, "ret"].dropna().to_numpy(float)
        if len(train) < 100:
            return pd.DataFrame(columns=columns)
        ar = fit_ar(train)
        places = [int(p) for p in group["origins"].iloc[0]]
        seen = [group.loc[group["pos"] <= p, "ret"].dropna().to_numpy(float) for p in places]
        frames, levels = [r[-lookback:] for r in seen], {}
        for size in {len(f) for f in frames}:
            same = [k for k, f in enumerate(frames) if len(f) == size]
            levels |= dict(zip(same, smooth(np.stack([frames[k] for k in same])), strict=True))
        for k, p in enumerate(places):
            level, deviation = levels[k]
            for h in horizons:
                for name, (mean, sigma) in (("ar", ar_path(seen[k], *ar, h)), ("ses", (level * h, deviation * math.sqrt(h)))):
                    up = 0.5 * math.erfc(-mean / sigma / math.sqrt(2)) if sigma > 0 else 0.5
                    rows.append((group["symbol"].iloc[0], name, h, int(group["fold"].iloc[0]), p, *(mean + z * sigma for z in Z.values()), up))
        return pd.DataFrame(rows, columns=columns)

    return own.groupBy("symbol", "fold").applyInPandas(run, "symbol string, model string, horizon int, fold int, pos bigint, q10 double, q50 double, q90 double, p_up double")


class Features(NamedTuple):
    """Rows (symbol, pos, names...) that boosted trees see, and how they grow."""

    rows: DataFrame
    names: tuple[str, ...]
    settings: boost.Settings = boost.Settings()


def walk_forward(returns: DataFrame, horizon: int, plan: Plan = Plan(), with_models: bool = True, features: Features | None = None, search: bool = False) -> DataFrame:
    """The leaderboards of all series (symbol, pos, ret) at a horizon: naive, drift, ar, ses, boosted trees on features, searched ARIMA and ETS, their blend and the best so far.

    What is read more than once is written to the shared folder; only the
    scored predictions stay there, as the board still reads them.
    """
    written = Written(returns.sparkSession, "walk")
    returns = written.save(returns, "returns")
    folds = written.save(evaluate.fold_table(returns.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), plan), "folds")
    columns = ["symbol", "model", "horizon", "fold", "pos", *QUANTILES, "p_up"]
    realized = written.save(evaluate.labels(returns, horizon), "labels")
    preds = evaluate.empirical(folds.select("symbol", "fold", "pos"), returns, horizon).select(*columns)
    if with_models:
        preds = preds.unionByName(statistical(folds, returns, (horizon,)).select(*columns))
    if search:
        preds = preds.unionByName(statespace.searched(folds, returns, (horizon,), QUANTILES, plan.refit_every).select(*columns))
    if features:
        rows = features.rows.select("symbol", "pos", *features.names).join(realized.select("symbol", "pos", "y"), ["symbol", "pos"])
        grown, _ = boost.forecasts(rows, folds, features.names, horizon, QUANTILES, plan.refit_every, settings=features.settings)
        preds = preds.unionByName(grown.select(*columns))
    preds = written.save(preds, "predictions")  # read by the losses, both blends and the board
    past = written.save(evaluate.past_losses(evaluate.losses(preds, realized), folds, horizon), "past")
    keys = ["symbol", "fold"]
    blended = evaluate.blend(preds, evaluate.inverse_loss_weights(past, keys), "ensemble").unionByName(evaluate.blend(preds, evaluate.best_only(past, keys), "auto_select"))
    block = max(math.ceil(horizon / plan.stride), plan.refit_every * math.ceil(plan.step / plan.stride))
    scored = written.save(evaluate.losses(preds.unionByName(blended.select(*columns)), realized), "scored")
    written.drop("returns", "folds", "labels", "predictions", "past")
    return evaluate.leaderboard(scored, horizon, block)
