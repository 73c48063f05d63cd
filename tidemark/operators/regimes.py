"""Trend and volatility regimes, pivots, and support and resistance levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import ordered, previous

from .indicators import realized_vol, rolling_percentile, sma


def trend_regime(bars: DataFrame, fast: int = 50, slow: int = 200, slope_bars: int = 20) -> DataFrame:
    out = bars.withColumn("sma_fast", sma(F.col("close"), fast)).withColumn("sma_slow", sma(F.col("close"), slow))
    out = out.withColumn("slow_before", previous("sma_slow", slope_bars))
    up = (F.col("close") > F.col("sma_fast")) & (F.col("sma_fast") > F.col("sma_slow")) & (F.col("sma_slow") > F.col("slow_before"))
    down = (F.col("close") < F.col("sma_fast")) & (F.col("sma_fast") < F.col("sma_slow")) & (F.col("sma_slow") < F.col("slow_before"))
    trend = F.when(F.col("slow_before").isNull(), "insufficient_data").when(up, "uptrend").when(down, "downtrend").otherwise("range")
    return out.withColumn("trend", trend).drop("slow_before")


def vol_regime(bars: DataFrame, n: int = 20, lookback: int = 756, least: int = 252) -> DataFrame:
    """bars with ret: vol20, its trailing percentile and the regime that names it."""
    out = bars.withColumn("vol20", realized_vol(F.col("ret"), n))
    out = out.withColumn("vol_pctile", rolling_percentile(F.col("vol20"), lookback, least))
    p = F.col("vol_pctile")
    return out.withColumn("vol_regime", F.when(p.isNull(), "insufficient_data").when(p > 95, "extreme").when(p > 75, "high").when(p < 25, "low").otherwise("normal"))


def swing_pivots(bars: DataFrame, k: int = 5) -> DataFrame:
    """Highs and lows that are the extreme of 2k + 1 bars, with the bar that confirmed each."""
    frame = ordered().rowsBetween(-k, k)
    whole = F.count(F.lit(1)).over(frame) == 2 * k + 1
    kinds = F.array_compact(F.array(
        F.when(whole & (F.col("high") == F.max("high").over(frame)), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))),
        F.when(whole & (F.col("low") == F.min("low").over(frame)), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))),
    ))
    out = bars.select("symbol", "date", F.lead("date", k).over(ordered()).alias("confirmed_at"), kinds.alias("pivots"))
    return out.select("symbol", "date", "confirmed_at", F.inline("pivots"))


def levels(prices: list[float], last: float, width: float, each: int) -> list[tuple[str, float, int]]:
    """Clusters of pivots on either side of the last close, nearest first; a cluster reaches width from its first member."""
    out = []
    for side, chosen in (("support", [p for p in prices if p < last]), ("resistance", [p for p in prices if p > last])):
        clusters: list[list[float]] = []
        for p in sorted(chosen, key=lambda p: (abs(p - last), p)):
            home = next((c for c in clusters if abs(p - c[0]) <= width), None)
            home.append(p) if home else clusters.append([p])
        out += [(side, sum(c) / len(c), len(c)) for c in clusters[:each]]
    return out


def support_resistance(bars: DataFrame, pivots: DataFrame, lookback: int = 250, merge: float = 0.5, each: int = 2) -> DataFrame:
    """Levels from pivots confirmed within the last bars of each symbol; bars need atr14. A series is one group."""
    recent = bars.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).filter(F.col("back") <= lookback)
    edge = recent.groupBy("symbol").agg(F.min("date").alias("since"), F.max("date").alias("as_of"), F.max_by("close", "date").alias("last"), F.max_by("atr14", "date").alias("atr"))
    near = pivots.join(edge, "symbol").filter((F.col("date") >= F.col("since")) & (F.col("confirmed_at") <= F.col("as_of")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = levels(group["price"].tolist(), group["last"].iloc[0], merge * group["atr"].iloc[0], each)
        return pd.DataFrame([(group["symbol"].iloc[0], k + 1, *r) for k, r in enumerate(rows)], columns=["symbol", "rank", "side", "price", "touches"])

    return near.groupBy("symbol").applyInPandas(run, "symbol string, rank int, side string, price double, touches int")


def rating(score: Column, strong: float = 0.45, weak: float = 0.15) -> Column:
    return F.when(score >= strong, "strong_buy").when(score >= weak, "buy").when(score <= -strong, "strong_sell").when(score <= -weak, "sell").otherwise("hold")
