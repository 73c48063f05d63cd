"""Causal features and horizon labels: a prefix of the data gives a prefix of the features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import ordered, previous, rolling, trailing

from . import indicators
from .calendars import weekdays_between

SUMS, VOLS, MEANS = (5, 10, 20, 60, 120), (5, 20, 60), (20, 50, 200)


def share(n: int) -> int:
    return math.ceil(0.6 * n)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def price_features(bars: DataFrame) -> DataFrame:
    """bars (symbol, date, open, high, low, close, volume, ret) with the feature columns.

    Features live on the level that the masked returns rebuild from the first
    bar; ranges and volumes are lagged by one bar, as they end after the
    decision.
    """
    r = F.col("ret")
    out = bars.withColumn("level", F.exp(F.sum(F.coalesce(r, F.lit(0.0))).over(trailing(None)))).withColumn("r1", r)
    for n in SUMS:
        out = out.withColumn(f"cum_{n}", rolling(F.sum, r, n, share(n)))
    for n in VOLS:
        out = out.withColumn(f"vol_{n}", rolling(F.stddev_samp, r, n, max(2, share(n))))
    for n in (5, 20):
        out = out.withColumn(f"vol_ratio_{n}_60", F.try_divide(F.col(f"vol_{n}"), F.col("vol_60")))
    level = F.col("level")
    out = out.withColumn("bb_pct_b", indicators.bollinger(level)["pct_b"])
    for n in MEANS:
        out = out.withColumn(f"dist_sma{n}", F.try_divide(level, indicators.sma(level, n)) - 1)
    out = out.withColumn("dd_252", level / rolling(F.max, level, 252, 60) - 1)
    out = out.withColumn("_range", F.try_divide(F.col("high") - F.col("low"), F.col("close"))).withColumn("_volume", F.when(F.col("volume") > 0, F.log("volume")))
    out = out.withColumn("_range", rolling(F.avg, F.col("_range"), 14, 8))
    sd = rolling(F.stddev_samp, F.col("_volume"), 20, 12)
    out = out.withColumn("_z", F.when(sd > 0, (F.col("_volume") - rolling(F.avg, F.col("_volume"), 20, 12)) / sd))
    out = out.withColumn("range_pct_14", previous("_range")).withColumn("volume_z20", previous("_z")).drop("_range", "_volume", "_z")
    angle = F.lit(2 * math.pi) * F.month("date") / 12
    out = out.withColumn("dow", F.weekday("date")).withColumn("month_sin", F.sin(angle)).withColumn("month_cos", F.cos(angle))
    names = [c for c, t in out.dtypes if t == "double" and c not in bars.columns]
    return out.withColumns({c: finite(F.col(c)) for c in names})


def with_recursive(rows: DataFrame) -> DataFrame:
    """rsi14 of the level and the MACD histogram against it."""
    return indicators.recursive(rows, {
        "rsi14": lambda g: indicators.rsi(g["level"].to_numpy(float)),
        "macd_rel": lambda g: indicators.macd(g["level"].to_numpy(float))[2] / g["level"].to_numpy(float),
    })


def sessions_to_expiry(date: Column, expiry: Column) -> Column:
    """Weekdays from the date up to its contract's last day."""
    return weekdays_between(date, expiry)


def with_labels(rows: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """y_h: the sum of the next h returns, null ones as zero, where enough are valid and all h rows are there."""
    for h in horizons:
        ahead = ordered().rowsBetween(1, h)
        whole = F.lead("date", h).over(ordered()).isNotNull()
        least = 1 if h == 1 else math.ceil(h / 2)
        rows = rows.withColumn(f"y_{h}", F.when(whole & (F.count("ret").over(ahead) >= least), F.sum(F.coalesce("ret", F.lit(0.0))).over(ahead)))
    return rows


def leaks(build, rows: DataFrame, cut, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(symbol, date, column) where features built on rows up to cut differ from those built on all rows."""
    whole = build(rows).filter(F.col("date") <= cut)
    part = build(rows.filter(F.col("date") <= cut))
    both = whole.alias("a").join(part.alias("b"), ["symbol", "date"])
    differs = lambda c: ~(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-12 + tolerance * F.abs(F.col(f"b.{c}")), F.lit(False)))
    found = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in columns]))
    return both.select("symbol", "date", F.explode(found).alias("column"))
