"""Next-open paper backtests in closed form: no loop over days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import forward_filled, ordered, previous, trailing

from .indicators import realized_vol, sma


def sma_targets(bars: DataFrame, fast: int = 50, slow: int = 200, down: float = 0.0) -> DataFrame:
    """bars with target: 1 while the fast average is above the slow one, else down; null until both are there."""
    quick, calm = sma(F.col("close"), fast), sma(F.col("close"), slow)
    return bars.withColumn("target", F.when(calm.isNull(), None).when(quick > calm, 1.0).otherwise(down))


def threshold_targets(p_up: Column, up: float = 0.55, low: float = 0.45, down: float = 0.0) -> Column:
    """1 from up on, down from low on, flat between; a missing forecast holds."""
    return F.when(p_up.isNull(), None).when(p_up >= up, 1.0).when(p_up <= low, down).otherwise(0.0)


def vol_targeted(rows: DataFrame, target_vol: float = 0.2, cap: float = 1.0) -> DataFrame:
    """rows (target, ret) with the held target scaled to a volatility; the last known scale holds."""
    scaled = rows.withColumn("_vol", realized_vol(F.col("ret"), 20))
    scale = forward_filled(F.when(F.col("_vol") > 0, F.least(F.lit(target_vol) / F.nullif(F.col("_vol"), F.lit(0.0)), F.lit(cap))))
    return scaled.withColumn("target", forward_filled(F.col("target")) * scale).drop("_vol")


def pnl_bars(bars: DataFrame) -> DataFrame:
    """bars (valid, roll) with overnight and intraday factors and their running level."""
    before, o, c = previous("close"), F.col("open"), F.col("close")
    good = lambda x: x.isNotNull() & (x > 0)
    first = before.isNull() & (F.row_number().over(ordered()) == 1)
    overnight = F.when(F.col("valid") & good(o) & good(before), o / F.nullif(before, F.lit(0.0))).otherwise(1.0)
    intraday = F.when((F.col("valid") | F.col("roll")) & good(o) & good(c), c / F.nullif(o, F.lit(0.0))).when(F.col("valid") & ~good(o) & good(c) & good(before), c / F.nullif(before, F.lit(0.0))).otherwise(1.0)
    out = bars.withColumn("overnight", F.when(first, 1.0).otherwise(overnight)).withColumn("intraday", F.when(first, 1.0).otherwise(intraday))
    return out.withColumn("level", F.product(F.col("overnight") * F.col("intraday")).over(trailing(None)))


def run(rows: DataFrame, cost: float = 0.001, slippage: float = 0.0, per_roll: float = 0.0) -> DataFrame:
    """rows (open, close, target, roll) with position, trade, cost, ret and equity.

    A target at a close is traded at the next open: overnight on the old
    weight, the trade with its cost, then the day on the new weight. A null
    target holds; targets are clipped to [-1, 1].
    """
    out = rows.withColumn("_pending", F.coalesce(forward_filled(F.when(F.col("target").isNotNull(), F.least(F.greatest(F.col("target"), F.lit(-1.0)), F.lit(1.0)))), F.lit(0.0)))
    out = out.withColumn("position", F.coalesce(previous("_pending"), F.lit(0.0))).withColumn("_held", F.coalesce(previous("position"), F.lit(0.0))).withColumn("_close", previous("close"))
    out = out.withColumn("trade", F.col("position") - F.col("_held"))
    opened = F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("_close"))
    paid = F.abs("trade") * (cost + slippage) + F.when(F.col("roll") & (F.col("position") != 0), F.abs("position") * per_roll).otherwise(0.0)
    out = out.withColumn("cost", paid)
    factor = (1 + F.col("_held") * (opened / F.col("_close") - 1)) * (1 - F.col("cost")) * (1 + F.col("position") * (F.col("close") / opened - 1))
    out = out.withColumn("_factor", F.when(F.col("_close").isNull(), 1.0).otherwise(factor))
    return out.withColumn("equity", F.product("_factor").over(trailing(None))).withColumn("ret", F.col("_factor") - 1).drop("_pending", "_held", "_close", "_factor")


def buy_and_hold(rows: DataFrame) -> DataFrame:
    return rows.withColumn("target", F.when(F.row_number().over(ordered()) == 1, 1.0))


def metrics(result: DataFrame) -> DataFrame:
    """One row a symbol, the first day apart."""
    days = result.withColumn("_n", F.row_number().over(ordered()))
    peak = F.greatest(F.max("equity").over(trailing(None)), F.lit(1.0))
    days = days.withColumn("_fall", F.col("equity") / peak - 1).filter("_n > 1")
    r, sd, n = F.col("ret"), F.stddev_samp("ret"), F.count("ret")
    daily = F.when(sd > 1e-12, F.avg("ret") / sd)
    growth = F.product(1 + r)
    return days.groupBy("symbol").agg(
        n.alias("days"), (growth - 1).alias("total_return"), F.when(growth > 0, F.pow(growth, F.lit(252.0) / n) - 1).otherwise(-1.0).alias("cagr"), (sd * math.sqrt(252)).alias("vol"),
        (daily * math.sqrt(252)).alias("sharpe"), (1.96 * F.sqrt((1 + 0.5 * daily * daily) / n) * math.sqrt(252)).alias("sharpe_ci"), F.min("_fall").alias("max_drawdown"),
        F.avg(F.when(F.col("position") != 0, (r > 0).cast("double"))).alias("hit_rate"), (F.sum(F.abs("trade")) * 252 / n).alias("turnover"), F.avg(F.abs("position")).alias("exposure"),
        F.count_if(F.abs("trade") > 1e-12).alias("trades"), F.sum("cost").alias("costs"),
    )


def excess(strategy: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("total_return", "cagr", "vol", "sharpe", "max_drawdown")) -> DataFrame:
    both = strategy.alias("s").join(benchmark.alias("b"), "symbol")
    return both.select("symbol", *[(F.col(f"s.{c}") - F.col(f"b.{c}")).alias(c) for c in columns])


def first_valid(rows: DataFrame) -> DataFrame:
    """Rows from each symbol's first target on."""
    start = F.min(F.when(F.col("target").isNotNull(), F.col("date"))).over(Window.partitionBy("symbol"))
    return rows.withColumn("_start", start).filter(F.col("date") >= F.col("_start")).drop("_start")
