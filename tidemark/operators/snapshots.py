"""What was known of every symbol at each of many decisions, as nested blocks.

A decision is a row (symbol, date); its session is the symbol's last bar up to
that date. Every block is either a trailing window of the bars, read at the
session, or an as-of join, so one pass serves all decisions and none sees what
comes later: a prefix of the data gives the same blocks.

Levels are rebuilt from the returns from the first bar on, and stated in units
of the session's close, as if they had been carried back from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import midrank, ordered, previous, trailing
from tidemark.sources.written import Written

from . import fundamentals, indicators, pit, regimes, risk, services

YEAR = 252
AT = ["symbol", "date"]


def enriched(bars: DataFrame) -> DataFrame:
    """bars (symbol, date, high, low, close, ret) with their position, level and all trailing values that the blocks state."""
    r, level = F.col("ret"), F.col("level")
    out = bars.withColumn("pos", F.row_number().over(ordered())).withColumn("level", F.exp(F.sum(F.coalesce(r, F.lit(0.0))).over(trailing(None))))
    out = out.withColumns({c: F.col(c) * level / F.col("close") for c in ("high", "low")})
    out = out.withColumns({f"change_{n}d": level / previous("level", n) - 1 for n in (1, 5, 20, 60)}).withColumn("change_1d", F.when(r.isNotNull(), F.col("change_1d")))
    years = out.groupBy("symbol", F.year("date").alias("_y")).agg(F.max_by("level", "date").alias("_end"))
    years = years.select("symbol", "_y", F.lag("_end").over(Window.partitionBy("symbol").orderBy("_y")).alias("_before"))
    out = out.withColumn("_y", F.year("date")).join(years, ["symbol", "_y"]).withColumn("change_ytd", level / F.col("_before") - 1).drop("_y", "_before")
    out = out.withColumns({"high_52w": F.max("high").over(trailing(YEAR)), "low_52w": F.min("low").over(trailing(YEAR)), "pct_from_52w_high": level / F.max("level").over(trailing(YEAR)) - 1})
    out = out.withColumns({f"sma{n}": indicators.sma(level, n) for n in (20, 50, 200)})
    return out.withColumn("history_days", F.count("ret").over(trailing(None)))


def with_recursive(rows: DataFrame) -> DataFrame:
    """rows with RSI, the MACD histogram and ATR of their level; one task holds one series."""
    of = lambda g, *names: (g[n].to_numpy(float) for n in names)
    return indicators.recursive(rows, {
        "rsi14": lambda g: indicators.rsi(*of(g, "level")), "macd_hist": lambda g: indicators.macd(*of(g, "level"))[2], "atr14": lambda g: indicators.atr(*of(g, "high", "low", "level")),
    })


def sessions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(symbol, date, session, row) of decisions (symbol, date): the last bar up to each, which must be there."""
    packed = rows.select("symbol", "date", F.struct(*rows.columns).alias("row"))
    met = pit.as_of_join(decisions.select(*AT).distinct(), packed.withColumnRenamed("date", "session"), "date", "session", ["session", "row"], by=("symbol",))
    return met.filter("session is not null")


def price_block() -> Column:
    """Of a session's row, in units of its close."""
    row = F.col("row")
    scale = row.close / row.level
    changes = [row[c].alias(c) for c in ("change_1d", "change_5d", "change_20d", "change_60d", "change_ytd")]
    levels = [(row[c] * scale).alias(c) for c in ("high_52w", "low_52w")]
    return F.struct(row.date.alias("last_date"), row.close.alias("last_close"), *changes, *levels, row.pct_from_52w_high.alias("pct_from_52w_high"))


def technical_block(recursive: bool = True) -> Column:
    row = F.col("row")
    scale = row.close / row.level
    priced = [(row[c] * scale).alias(c) for c in ("sma20", "sma50", "sma200", *(("macd_hist", "atr14") if recursive else ()))]
    return F.struct(*priced, *([row.rsi14.alias("rsi14")] if recursive else []), row.trend.alias("trend"), row.vol20.alias("vol20"), row.vol_pctile.alias("vol_percentile_3y"), row.vol_regime.alias("vol_regime"))


def risk_blocks(at: DataFrame, rows: DataFrame, target_vol: float = 0.2) -> DataFrame:
    """(symbol, date, risk): aggregates of the last year's simple returns before each session, and the size they allow.

    A session meets its year by buckets of positions: two of them hold it.
    """
    bucket = lambda c: F.floor(F.col(c) / YEAR)
    places = at.select(*AT, F.col("row.pos").alias("p")).withColumn("b", F.explode(F.array(bucket("p"), bucket("p") - 1)))
    simple = rows.filter("ret is not null").select("symbol", F.col("date").alias("day"), "pos", F.expm1("ret").alias("r"), bucket("pos").alias("b"))
    year = places.join(simple, ["symbol", "b"]).filter("pos <= p and pos > p - 252")
    keyed = year.select(F.to_json(F.struct("symbol", "date")).alias("symbol"), F.struct("symbol", "date").alias("at"), F.col("day").alias("date"), "r")
    keyed = Written(at.sparkSession, "year").save(keyed, "returns")  # each aggregate reads it
    names = keyed.groupBy("symbol").agg(F.first("at").alias("at"))
    out = risk.summary(keyed).join(names, "symbol")
    fields = [c for c in out.columns if c not in ("symbol", "at")]
    out = out.select("at.symbol", "at.date", F.struct(*fields).alias("year"))
    sized = at.select(*AT, F.col("row.vol20").alias("vol20"), F.col("row.history_days").alias("history_days")).join(out, AT, "left")
    sized = sized.withColumn("vol", F.greatest("vol20", "year.annual_vol")).withColumn("strategy_drawdown", F.lit(None).cast("double"))
    sized = risk.position_size(sized, target_vol)
    return sized.select(*AT, F.struct("vol20", "year", "fraction", "binding").alias("risk"))


def season_blocks(at: DataFrame, rows: DataFrame) -> DataFrame:
    """(symbol, date, seasonality): statistics of the session's calendar month over the months that ended before it."""
    monthly = fundamentals.monthly_returns(rows).select("symbol", "month_end", "ret", F.month("month_end").alias("month"))
    asked = at.select(*AT, "session", F.month("session").alias("month"))
    met = asked.join(monthly, ["symbol", "month"]).filter(F.col("month_end") < F.col("session"))  # a row for each year
    sd = F.stddev_samp("ret")
    stats = met.groupBy(*AT).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.percentile("ret", 0.5).alias("median"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"),
        F.when((F.count("ret") > 1) & (sd > 0), F.avg("ret") / (sd / F.sqrt(F.count("ret")))).alias("t_stat"), F.min(F.year("month_end")).alias("first_year"), F.max(F.year("month_end")).alias("last_year"),
    )
    return stats.select(*AT, F.struct(*[c for c in stats.columns if c not in AT]).alias("seasonality"))


def inventory_blocks(at: DataFrame, weekly: DataFrame, clock: str = "14:30:00", zone: str = "America/New_York") -> DataFrame:
    """(symbol, date, inventories): the latest public period of weekly (period, value, available_at) against its seasonal band."""
    series = fundamentals.inventory(weekly.select("period", "value")).join(weekly.select("period", "available_at"), "period")
    series = series.withColumn("inventories", F.struct("period", "available_at", "value", "wow", "dev", "dev_pct", "band_pos", "wow_vs_seasonal"))
    asked = at.select(*AT, pit.utc(F.col("session"), clock, zone).alias("t"))
    return pit.as_of_join(asked, series, "t", "available_at", ["period", "inventories"], tie="period", order_by="period").select(*AT, "inventories")


def cot_blocks(at: DataFrame, reports: DataFrame, clock: str = "14:30:00", zone: str = "America/New_York") -> DataFrame:
    asked = at.select(*AT, pit.utc(F.col("session"), clock, zone).alias("t"))
    return asked.join(services.positions_at(reports, asked.select("symbol", "t").distinct()), ["symbol", "t"]).select(*AT, F.col("positions").alias("cot"))


def crack_blocks(at: DataFrame, legs: DataFrame) -> DataFrame:
    """(symbol, date, crack) from legs (date, cl, rb, ho): the last spread up to the session and its percentile in a year."""
    spread = fundamentals.spread_321(legs).select(F.lit("crack").alias("symbol"), "date", F.col("spread").alias("x"))
    spread = spread.withColumn("pctile_1y", midrank(F.col("x"), YEAR, 2)).select(F.col("date").alias("day"), F.struct("date", F.col("x").alias("value"), "pctile_1y").alias("crack"))
    return pit.as_of_join(at.select(*AT, "session"), spread, "session", "day", ["crack"]).select(*AT, "crack")


def curve_blocks(at: DataFrame, settles: DataFrame, contracts: int = 12, days: int = 30) -> DataFrame:
    """(symbol, date, curve) from settles (symbol, expiry, day, settle): of each session's next contracts the last settle within some days, up to the first without one; two at least."""
    listed = settles.select("symbol", "expiry").distinct()
    order = Window.partitionBy(*AT).orderBy("expiry")
    asked = at.select(*AT, "session").join(listed, "symbol").filter(F.col("expiry") >= F.col("session")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= contracts)
    met = pit.as_of_join(asked, settles.withColumn("on", F.col("day")), "session", "day", ["on", "settle"], by=("symbol", "expiry"))
    met = met.withColumn("settle", F.when(F.col("on") >= F.date_sub("session", days), F.col("settle")))
    whole = met.withColumn("gaps", F.count_if(F.col("settle").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("gaps = 0")
    keyed = whole.select(F.to_json(F.struct(*AT)).alias("symbol"), F.struct(*AT).alias("at"), "expiry", "settle")
    names = keyed.groupBy("symbol").agg(F.first("at").alias("at"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    metrics = fundamentals.curve_metrics(keyed)
    return metrics.join(names, "symbol").select("at.symbol", "at.date", F.struct(*[c for c in metrics.columns if c != "symbol"]).alias("curve"))


def notes_of(at: DataFrame, issues: DataFrame) -> DataFrame:
    """(symbol, date, notes): the checks with an error or a warning dated up to the session, worst first by name."""
    first = issues.filter("severity <> 'info'").groupBy("symbol", "check", "severity").agg(F.min("date").alias("since"))
    met = at.select(*AT, "session").join(first, "symbol", "left")
    said = F.when(F.col("since") <= F.col("session"), F.format_string("data quality [%s] %s", F.col("severity"), F.col("check")))
    return met.groupBy(*AT).agg(F.array_sort(F.collect_set(said)).alias("notes"))


def snapshot_at(
    bars: DataFrame, decisions: DataFrame, weekly: DataFrame | None = None, reports: DataFrame | None = None, legs: DataFrame | None = None, settles: DataFrame | None = None, issues: DataFrame | None = None
) -> DataFrame:
    """(symbol, date, session, price, technicals, risk, seasonality, and inventories, cot, crack, curve and notes of what is given).

    A block is null where nothing was known; a decision before the first bar has
    no row. Repeated decisions count once.
    """
    written = Written(bars.sparkSession, "snapshots")  # all blocks read both
    rows = written.save(with_recursive(regimes.vol_regime(trend_of_level(enriched(bars)))), "rows")
    at = written.save(sessions(rows, decisions), "sessions")
    out = at.select(*AT, "session", price_block().alias("price"), technical_block().alias("technicals"))
    parts = [risk_blocks(at, rows), season_blocks(at, rows)]
    parts += [f(at, x) for f, x in ((inventory_blocks, weekly), (cot_blocks, reports), (crack_blocks, legs), (curve_blocks, settles), (notes_of, issues)) if x is not None]
    for part in parts:
        out = out.join(part, AT, "left")
    return out


def trend_of_level(rows: DataFrame) -> DataFrame:
    """rows with the trend of their level, as regimes.trend_regime() has it for closes."""
    plain = rows.withColumn("_close", F.col("close")).withColumn("close", F.col("level"))
    return regimes.trend_regime(plain).withColumn("close", F.col("_close")).drop("_close")


def anonymous(snapshots: DataFrame, base: float = 100.0) -> DataFrame:
    """snapshots without names, dates and units: prices in units of base at the symbol's first session, dates as days before the decision.

    (series, decision, price, technicals, risk, seasonality): series numbers the symbols by a hash of their names.
    """
    first = Window.partitionBy("symbol").orderBy("date")
    factor = F.lit(base) / F.first("price.last_close").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = snapshots.withColumn("_f", factor).withColumn("decision", F.row_number().over(first))
    price, tech = F.col("price"), F.col("technicals")
    for name in ("last_close", "high_52w", "low_52w"):
        price = price.withField(name, F.col(f"price.{name}") * F.col("_f"))
    for name in ("sma20", "sma50", "sma200", "macd_hist", "atr14"):
        tech = tech.withField(name, F.col(f"technicals.{name}") * F.col("_f"))
    price = price.withField("days_before", F.datediff("date", "price.last_date")).dropFields("last_date")
    season = F.col("seasonality").dropFields("first_year", "last_year")
    return marked.select(F.sha2("symbol", 256).substr(1, 8).alias("series"), "decision", price.alias("price"), tech.alias("technicals"), "risk", season.alias("seasonality"))
