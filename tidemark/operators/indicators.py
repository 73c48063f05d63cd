"""Technical indicators: expressions over (symbol, date) rows, and grouped recursions where a value needs the one before."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import midrank, previous, rolling, trailing

PERIODS = 252


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg, x, n)


def log_returns(close: Column) -> Column:
    before = previous(close)
    return F.when((close > 0) & (before > 0), F.log(close / before))


def realized_vol(returns: Column, n: int = 20, periods: int = PERIODS, share: float = 0.8) -> Column:
    return rolling(F.stddev_samp, returns, n, max(2, math.ceil(n * share))) * math.sqrt(periods)


def bollinger(close: Column, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(close, n), rolling(F.stddev_pop, close, n)
    upper, lower = mid + k * sd, mid - k * sd
    return {
        "mid": mid,
        "upper": upper,
        "lower": lower,
        "pct_b": F.when(upper > lower, F.try_divide(close - lower, upper - lower)),
        "bandwidth": F.when(mid != 0, F.try_divide(upper - lower, mid)),
    }


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = previous(close)
    return F.when(before.isNotNull(), F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


def drawdown(level: Column) -> Column:
    return level / F.max(level).over(trailing(None)) - 1


def pct_change(level: Column, n: int) -> Column:
    return F.try_divide(level, previous(level, n)) - 1


def rolling_percentile(x: Column, window: int, least: int) -> Column:
    return midrank(x, window, least)


def recursive_average(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Seeded by the mean of the first n values; a gap after the first value is an error."""
    out = np.full(len(x), np.nan)
    there = np.flatnonzero(~np.isnan(x))
    if not len(there):
        return out
    start = int(there[0])
    if len(there) != len(x) - start:
        raise ValueError("a value is missing inside the series")
    if len(x) - start >= n:
        at = start + n - 1
        out[at] = y = x[start : at + 1].mean()
        for k in range(at + 1, len(x)):
            y += alpha * (x[k] - y)
            out[k] = y
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return recursive_average(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return recursive_average(x, n, 1 / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    step = np.r_[np.nan, np.diff(close)] if len(close) else close
    gain, loss = wilder(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), n), wilder(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(gain), np.nan, np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), 100 - 100 / (1 + gain / loss)))


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(close, fast) - ema(close, slow)
    trigger = ema(line, signal)
    return line, trigger, line - trigger


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]] if len(close) else close
    spread = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    return wilder(np.where(np.isnan(before), np.nan, spread), n)


def recursive(df: DataFrame, outputs: dict[str, Callable[[pd.DataFrame], np.ndarray]], keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """df with a column for each function of a whole ordered series; one task holds one series."""
    fields = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` double" for c in outputs)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(**{c: f(group) for c, f in outputs.items()})

    return df.groupBy(*keys).applyInPandas(run, fields)


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """ema20, wilder14, rsi14, macd with its signal and histogram, and atr14."""
    close = lambda g: g["close"].to_numpy(float)
    return recursive(bars, {
        "ema20": lambda g: ema(close(g), 20),
        "wilder14": lambda g: wilder(close(g), 14),
        "rsi14": lambda g: rsi(close(g)),
        "macd": lambda g: macd(close(g))[0],
        "macd_signal": lambda g: macd(close(g))[1],
        "macd_hist": lambda g: macd(close(g))[2],
        "atr14": lambda g: atr(g["high"].to_numpy(float), g["low"].to_numpy(float), close(g)),
    })
