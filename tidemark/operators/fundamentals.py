"""Seasonality, inventories, positioning, spreads and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import midrank, previous


def monthly_returns(returns: DataFrame, coverage: float = 0.8) -> DataFrame:
    """(symbol, month_end, ret): sums of log returns of months with enough valid days."""
    sums = returns.groupBy("symbol", F.last_day("date").alias("month_end")).agg(F.sum("ret").alias("ret"), (F.count("ret") / F.count(F.lit(1))).alias("share"))
    return sums.filter((F.col("share") >= coverage) & F.col("ret").isNotNull()).drop("share")


def month_stats(monthly: DataFrame, as_of: Column | None = None) -> DataFrame:
    """By symbol and calendar month: n, mean, median, hit rate, t statistic, first and last year; of months that ended before as_of."""
    monthly = monthly if as_of is None else monthly.filter(F.col("month_end") < as_of)
    sd = F.stddev_samp("ret")
    return monthly.groupBy("symbol", F.month("month_end").alias("month")).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.percentile("ret", 0.5).alias("median"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"),
        F.when((F.count("ret") > 1) & (sd > 0), F.avg("ret") / (sd / F.sqrt(F.count("ret")))).alias("t_stat"),
        F.min(F.year("month_end")).alias("first_year"), F.max(F.year("month_end")).alias("last_year"),
    )


def folded_week(date: Column) -> Column:
    return F.least(F.weekofyear(date), F.lit(52))


def seasonal_band(weekly: DataFrame, value: str = "value", years: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """weekly (period, value) with the mean, least, most and count of the same week in the years before.

    The key is the calendar year with the ISO week; of several values in one
    the last there is counts.
    """
    keyed = weekly.withColumn("_y", F.year("period")).withColumn("_w", folded_week(F.col("period")))
    yearly = keyed.filter(F.col(value).isNotNull()).groupBy(*by, "_y", "_w").agg(F.max_by(value, "period").alias("_v"))
    frame = Window.partitionBy(*by, "_w").orderBy("_y").rangeBetween(-years, -1)
    bands = keyed.select(*by, "_y", "_w").distinct().join(yearly, [*by, "_y", "_w"], "left")
    bands = bands.select(*by, "_y", "_w", F.avg("_v").over(frame).alias("band_avg"), F.min("_v").over(frame).alias("band_min"), F.max("_v").over(frame).alias("band_max"), F.count("_v").over(frame).alias("band_n"))
    return keyed.join(bands, [*by, "_y", "_w"]).drop("_y", "_w")


def inventory(weekly: DataFrame, years: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The level and its weekly change against their seasonal bands; without by it is one series, a row a week."""
    steps = weekly.withColumn("wow", F.col("value") - F.lag("value").over(Window.partitionBy(*by).orderBy("period")))
    level = seasonal_band(steps, "value", years, by)
    change = seasonal_band(steps, "wow", years, by).select(*by, "period", F.col("band_avg").alias("wow_seasonal"))
    out = level.join(change, [*by, "period"])
    width = F.col("band_max") - F.col("band_min")
    return out.select(
        *level.columns, "wow_seasonal", (F.col("value") - F.col("band_avg")).alias("dev"), F.try_divide(F.col("value") - F.col("band_avg"), F.col("band_avg")).alias("dev_pct"),
        F.when(width > 0, F.try_divide(F.col("value") - F.col("band_min"), width)).alias("band_pos"), (F.col("wow") - F.col("wow_seasonal")).alias("wow_vs_seasonal"),
    )


def positioning(rows: DataFrame, weeks: int = 156, least: int = 78) -> DataFrame:
    """rows (symbol, date, long, short, open_interest) with net, share, change and trailing percentile."""
    out = rows.withColumn("net", F.col("long") - F.col("short"))
    out = out.withColumn("share", F.try_divide(F.col("net"), F.col("open_interest"))).withColumn("change", F.col("net") - previous("net"))
    return out.withColumn("pctile", midrank(F.col("net"), weeks, least))


def spread_321(legs: DataFrame) -> DataFrame:
    """(date, spread) of legs (date, cl, rb, ho) that are all there."""
    return legs.dropna(subset=["cl", "rb", "ho"]).select("date", ((2 * F.col("rb") * 42 + F.col("ho") * 42 - 3 * F.col("cl")) / 3).alias("spread"))


def percentile_last(rows: DataFrame, window: int) -> DataFrame:
    """(symbol, pctile): the mid-rank of the last value among the last values there are."""
    recent = rows.filter("x is not null").withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).filter(F.col("back") <= window)
    last = F.max_by("x", "date").over(Window.partitionBy("symbol"))
    marked = recent.withColumn("last", last)
    less, same, n = F.sum((F.col("x") < F.col("last")).cast("int")), F.sum((F.col("x") == F.col("last")).cast("int")), F.count(F.lit(1))
    return marked.groupBy("symbol").agg(F.when(n >= 2, 100.0 * (less + 0.5 * (same - 1)) / F.nullif(n - 1, F.lit(0))).alias("pctile"))


def curve_metrics(curve: DataFrame, flat: float = 0.001) -> DataFrame:
    """curve (symbol, expiry, settle) of each symbol: spreads, slope and shape; needs two positive settles."""
    order = Window.partitionBy("symbol").orderBy("expiry")
    steps = curve.filter("settle > 0").withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("settle").over(order)).withColumn("rel", F.try_divide(F.col("next"), F.col("settle")) - 1)
    steps = steps.withColumn("next_expiry", F.lead("expiry").over(order))
    first = lambda c: F.max(F.when(F.col("at") == 1, F.col(c)))
    rel, last, enough = F.col("rel"), F.max_by("settle", "expiry"), F.count(F.lit(1)) >= 2
    shape = F.when(F.every(F.coalesce(F.abs(rel) <= flat, F.lit(True))), "flat").when(F.every(F.coalesce(rel <= flat, F.lit(True))), "backwardation").when(F.every(F.coalesce(rel >= -flat, F.lit(True))), "contango").otherwise("mixed")
    yearly = lambda end, settle: F.try_divide(F.log(F.try_divide(first("settle"), settle)), F.datediff(end, first("expiry")) / 365.25)
    return steps.groupBy("symbol").agg(
        F.when(enough, first("settle") - first("next")).alias("m1_m2"),
        F.when(enough, F.try_divide(first("settle") - first("next"), first("next"))).alias("m1_m2_pct"),
        F.when(enough, yearly(first("next_expiry"), first("next"))).alias("roll_yield"),
        F.when(enough, first("settle") - last).alias("front_back"),
        F.when(enough, yearly(F.max("expiry"), last)).alias("front_back_ann"),
        F.when(enough, shape).alias("shape"),
        F.count(F.lit(1)).cast("int").alias("contracts"),
    )
