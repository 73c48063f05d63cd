"""The data of charts and tables: what a figure draws, as rows; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import trailing

from . import indicators
from .evaluate import QUANTILES
from .reports import weekdays_after


def price_bands(close: Column, forecast: DataFrame, origin: DataFrame) -> DataFrame:
    """forecast (symbol, horizon, quantiles of the log return) with prices, from origin (symbol, close); null where the close is not positive."""
    priced = {c: F.when(F.col("_close") > 0, F.col("_close") * F.exp(c)) for c in QUANTILES}
    return forecast.join(origin.select("symbol", close.alias("_close")), "symbol").select("symbol", "horizon", *[v.alias(f"p{c[1:]}") for c, v in priced.items()], "p_up")


def fan(bars: DataFrame, bands: DataFrame, as_of: Column, lookback: int = 120) -> DataFrame:
    """(symbol, kind, at, low, mid, high): the last closes up to as_of, then the band of each horizon, that many weekdays on."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))
    history = bars.filter((F.col("date") <= as_of) & F.col("close").isNotNull()).withColumn("_b", back).filter(F.col("_b") <= lookback)
    later = weekdays_after(as_of, F.col("horizon"))
    drawn = bands.select("symbol", F.lit("band").alias("kind"), later.alias("at"), F.col("p10").alias("low"), F.col("p50").alias("mid"), F.col("p90").alias("high"))
    return history.select("symbol", F.lit("close").alias("kind"), F.col("date").alias("at"), F.col("close").alias("low"), F.col("close").alias("mid"), F.col("close").alias("high")).unionByName(drawn)


def price_chart(bars: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """bars with the moving averages and bands that a price chart shows; levels (symbol, price) beside them as an array."""
    band = indicators.bollinger(F.col("close"))
    out = bars.withColumn("sma50", indicators.sma(F.col("close"), 50)).withColumn("sma200", indicators.sma(F.col("close"), 200)).withColumn("bb_upper", band["upper"]).withColumn("bb_lower", band["lower"])
    return out if levels is None else out.join(levels.groupBy("symbol").agg(F.array_sort(F.collect_set("price")).alias("levels")), "symbol", "left")


def equity_chart(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(symbol, date, equity, benchmark, drawdown, position) of two backtests."""
    peak = F.greatest(F.max("equity").over(trailing(None)), F.lit(1.0))
    own = strategy.withColumn("drawdown", F.col("equity") / peak - 1)
    return own.join(benchmark.select("symbol", "date", F.col("equity").alias("benchmark")), ["symbol", "date"], "left").select("symbol", "date", "equity", "benchmark", "drawdown", "position")


def horizon_table(bands: DataFrame, board: DataFrame, choice: DataFrame) -> DataFrame:
    """One row a symbol and horizon: bands, skill, coverage, direction, adjusted p and the verdict of the chosen model."""
    own = board.select("symbol", "horizon", "model", "skill", "coverage", "dir_acc", "dm_p_adj")
    picked = choice.join(own, ["symbol", "horizon", "model"], "left")
    return bands.join(picked, ["symbol", "horizon"], "left").select("symbol", F.concat(F.col("horizon").cast("string"), F.lit("d")).alias("horizon"), "model", "p10", "p50", "p90", "p_up", "skill", "coverage", "dir_acc", "dm_p_adj", "verdict")


def metrics_table(compared: DataFrame) -> DataFrame:
    """(symbol, metric, strategy, benchmark) of decisions.compare(), a row for each number."""
    names = [f.name for f in compared.schema["strategy"].dataType.fields]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"strategy.{n}").cast("double").alias("strategy"), F.col(f"benchmark.{n}").cast("double").alias("benchmark")) for n in names])
    return compared.select("symbol", F.inline(rows))


def skill_chart(board: DataFrame) -> DataFrame:
    """(symbol, horizon, model, skill, edge), best first within each."""
    rank = F.row_number().over(Window.partitionBy("symbol", "horizon").orderBy(F.col("skill").desc_nulls_last(), "model"))
    return board.select("symbol", "horizon", "model", "skill", "edge", rank.alias("rank"))


def markdown(rows: DataFrame, keys: list[str], title: str = "") -> DataFrame:
    """(keys, text): the other columns as a Markdown list, one text a row; doubles to six digits, nulls as n/a."""
    shown = lambda c, t: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.6g", c)) if t == "double" else F.col(c).cast("string"), F.lit("n/a"))
    lines = [F.concat(F.lit(f"- **{c}**: "), shown(c, t)) for c, t in rows.dtypes if c not in keys]
    head = F.concat(F.lit(f"# {title} " if title else "# "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))
    return rows.select(*keys, F.concat_ws("\n", head, F.lit(""), *lines).alias("text"))


def html(texts: DataFrame, keys: list[str]) -> DataFrame:
    """markdown() texts as HTML: marked-up characters escaped, headings and list items tagged."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, r"(?m)^# (.*)$", "<h1>$1</h1>"), r"(?m)^- (.*)$", "<li>$1</li>"), r"\*\*([^*]+)\*\*", "<b>$1</b>")
    return texts.select(*keys, F.concat(F.lit("<!doctype html><meta charset=\"utf-8\">"), body).alias("html"))
