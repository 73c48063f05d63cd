"""Risk and performance aggregates over simple returns; nulls are dropped, not zero."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import trailing

PERIODS = 252
TINY = 1e-12


def equity(r: Column) -> Column:
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(trailing(None))


def annualized_return(r: Column) -> Column:
    growth, n = F.product(1 + r), F.count(r)
    return F.when(n == 0, None).when(growth <= 0, -1.0).otherwise(F.pow(growth, F.lit(float(PERIODS)) / F.when(n > 0, n)) - 1)


def annualized_vol(r: Column) -> Column:
    return F.when(F.count(r) >= 2, F.stddev_samp(r) * math.sqrt(PERIODS))


def sharpe(r: Column, rf: float = 0.0) -> Column:
    sd = F.stddev_samp(r)
    return F.when(sd > TINY, (F.avg(r) - rf / PERIODS) / sd * math.sqrt(PERIODS))


def downside_deviation(r: Column, target: float = 0.0) -> Column:
    return F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r - target, F.lit(0.0)), 2)))) * math.sqrt(PERIODS)


def sortino(r: Column, target: float = 0.0) -> Column:
    down = downside_deviation(r, target)
    return F.when(down > TINY, (F.avg(r) - target) * PERIODS / down)


def hit_rate(r: Column) -> Column:
    return F.avg(F.when(r != 0, (r > 0).cast("double")))


def var_historical(r: Column, level: float = 0.95) -> Column:
    return -F.percentile(r, 1 - level)


def cvar_historical(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """(symbol, cvar): the mean loss beyond the quantile; the cut comes from one pass and meets the rows in a second."""
    cut = returns.groupBy("symbol").agg(F.percentile("r", 1 - level).alias("cut"))
    return returns.join(cut, "symbol").groupBy("symbol").agg((-F.avg(F.when(F.col("r") <= F.col("cut"), F.col("r")))).alias("cvar"))


def max_drawdown(returns: DataFrame) -> DataFrame:
    """(symbol, max_drawdown): the starting capital counts as a peak."""
    level = returns.select("symbol", "date", equity(F.col("r")).alias("level"))
    peak = F.greatest(F.max("level").over(trailing(None)), F.lit(1.0))
    return level.withColumn("fall", F.col("level") / peak - 1).groupBy("symbol").agg(F.min("fall").alias("max_drawdown"))


def beta(pairs: DataFrame) -> DataFrame:
    """(symbol, beta) of r against m on the dates that have both."""
    both = pairs.filter("r is not null and m is not null").groupBy("symbol")
    return both.agg(F.when((F.count("*") >= 3) & (F.var_samp("m") > 0), F.covar_samp("r", "m") / F.nullif(F.var_samp("m"), F.lit(0.0))).alias("beta"))


def summary(returns: DataFrame) -> DataFrame:
    """One row a symbol with every aggregate above."""
    r = F.col("r")
    flat = returns.groupBy("symbol").agg(
        F.count(r).alias("n"), annualized_return(r).alias("annual_return"), annualized_vol(r).alias("annual_vol"), sharpe(r).alias("sharpe"),
        downside_deviation(r).alias("downside"), sortino(r).alias("sortino"), hit_rate(r).alias("hit_rate"), var_historical(r).alias("var95"),
    )
    out = flat.join(max_drawdown(returns), "symbol").join(cvar_historical(returns), "symbol")
    return out.withColumn("calmar", F.when(F.col("max_drawdown") != 0, F.try_divide(F.col("annual_return"), F.abs("max_drawdown"))))


def position_size(rows: DataFrame, target_vol: float = 0.2, most: float = 0.25, gross: float = 1.0, stop: float = 0.3, history: int = 252) -> DataFrame:
    """rows (vol, history_days, strategy_drawdown) with fraction, vol_target_fraction, binding and reasons.

    The gates come in this order: history, drawdown stop (no stop where the
    drawdown is null), a volatility above zero and finite; then the least of
    the volatility target and the limits, the target first where they are equal.
    """
    vol, none = F.col("vol").cast("double"), F.lit(None).cast("double")
    valid = F.coalesce((vol > 0) & ~F.isnan(vol) & (vol < float("inf")), F.lit(False))
    target = F.when(valid, F.lit(target_vol) / vol)
    limits = (("vol_target", target), ("max_position_fraction", F.lit(most)), ("max_gross_exposure", F.lit(gross)))
    least = F.array_min(F.array(*[F.struct(size.alias("size"), F.lit(k).alias("at"), F.lit(name).alias("binding")) for k, (name, size) in enumerate(limits)]))
    percent = lambda x, digits: F.format_string(f"%.{digits}f%%", x * 100)
    answer = lambda size, own, binding, *why: F.struct(size.alias("fraction"), own.alias("vol_target_fraction"), binding.alias("binding"), F.array(*why).alias("reasons"))
    capped = F.when(least["binding"] == "vol_target", F.lit("vol target within limits")).otherwise(F.concat(F.lit("capped by "), least["binding"]))
    chosen = (
        F.when(F.coalesce(F.col("history_days") < history, F.lit(True)), answer(F.lit(0.0), none, F.lit("min_history_days"), F.format_string(f"only %d days of history (< {history})", F.coalesce("history_days", F.lit(0)).cast("long"))))
        .when(F.col("strategy_drawdown") <= -stop, answer(F.lit(0.0), none, F.lit("max_drawdown_stop"), F.concat(F.lit("strategy drawdown "), percent(F.col("strategy_drawdown").cast("double"), 1), F.lit(" beyond stop "), percent(F.lit(-stop), 0))))
        .when(~valid, answer(F.lit(0.0), none, F.lit("invalid_vol"), F.lit("volatility unavailable")))
        .otherwise(answer(least["size"], target, least["binding"], F.concat(F.lit("vol target "), percent(F.lit(target_vol), 0), F.lit(" / realized "), percent(vol, 1), F.format_string(" = %.2f", target)), capped))
    )
    return rows.withColumn("_chosen", chosen).select(*rows.columns, "_chosen.*")
