"""Queries of the time-series operators over the driver's tables, each beside its SQL.

Orders make the bars (a symbol for each status), line items the weekly
series, events the log.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import midrank, ordered, previous, rolling, trailing
from tidemark.operators import backtest, bars, evaluate, features, forecast, fundamentals, indicators, pit, quality, regimes, reports, risk, rolls, text
from tidemark.sources.tables import table

from . import closed_days
from .catalog import register

BARS = """bars AS (
  SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""
RETURNS = BARS + """, returns AS (
  SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret, row_number() OVER w AS pos
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
SIMPLE = RETURNS + ", simple AS (SELECT symbol, date, pos, exp(ret / 50) - 1 AS r FROM returns WHERE ret IS NOT NULL)"
WEEKLY = """weekly AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS period, sum(l_quantity) AS value FROM lineitem GROUP BY 1)"""


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return bars.daily_bars(orders, F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def day_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_bars(spark, sf_dir).withColumn("ret", indicators.log_returns(F.col("close"))).withColumn("pos", F.row_number().over(ordered()))


def simple_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_returns(spark, sf_dir).filter("ret is not null").select("symbol", "date", "pos", F.expm1(F.col("ret") / 50).alias("r"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.weekly_sum(table(spark, sf_dir, "lineitem"), F.col("l_shipdate"), F.col("l_quantity"))


def column(name: str, value: Callable[[], Column], sql: str, digits: int = 6, source: Callable = day_returns, head: str = RETURNS, view: str = "returns") -> None:
    """A query of one expression over the bars."""
    keys = "symbol, date"
    register(name, f"WITH {head} SELECT {keys}, round({sql}, {digits}) AS x FROM {view}")(lambda spark, sf_dir: source(spark, sf_dir).select("symbol", "date", F.round(value(), digits).alias("x")))


def over(n: int | None = None, more: str = "") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW{more})"


def guard(sql: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {least or n} THEN {sql} END"


def c(name: str) -> Column:
    return F.col(name)


def newest_first():
    return Window.partitionBy("symbol").orderBy(c("date").desc())


FLAGSHIP_DIGITS = {"ret": 6, "sma_fast": 4, "sma_slow": 4, "vol20": 6, "rsi14": 4}


@register("flagship", f"""WITH RECURSIVE {RETURNS}, {WEEKLY}, steps AS (
  SELECT symbol, pos, greatest(close - b, 0) AS up, greatest(b - close, 0) AS down FROM (SELECT symbol, pos, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS b FROM returns) WHERE b IS NOT NULL),
y(symbol, pos, up, down) AS (
  SELECT symbol, 15::BIGINT, avg(up), avg(down) FROM steps WHERE pos BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT s.symbol, s.pos, y.up + (1.0::DOUBLE / 14) * (s.up - y.up), y.down + (1.0::DOUBLE / 14) * (s.down - y.down) FROM y JOIN steps s ON s.symbol = y.symbol AND s.pos = y.pos + 1),
a AS (SELECT *, CASE WHEN count(close) {over(50)} >= 50 THEN avg(close) {over(50)} END AS sma_fast, CASE WHEN count(close) {over(200)} >= 200 THEN avg(close) {over(200)} END AS sma_slow,
  CASE WHEN count(ret) {over(20)} >= 16 THEN stddev_samp(ret) {over(20)} * sqrt(252) END AS vol20 FROM returns),
b AS (SELECT *, lag(sma_slow, 20) OVER (PARTITION BY symbol ORDER BY date) AS before, max(date) OVER (PARTITION BY symbol) AS latest FROM a),
found AS (SELECT symbol, max(period) AS period FROM b JOIN weekly ON period + 5 <= date WHERE date = latest GROUP BY symbol)
SELECT b.symbol, b.date, open, high, low, close, volume, round(ret, 6) AS ret, b.pos, round(sma_fast, 4) AS sma_fast, round(sma_slow, 4) AS sma_slow,
  CASE WHEN before IS NULL THEN 'insufficient_data' WHEN close > sma_fast AND sma_fast > sma_slow AND sma_slow > before THEN 'uptrend' WHEN close < sma_fast AND sma_fast < sma_slow AND sma_slow < before THEN 'downtrend' ELSE 'range' END AS trend,
  round(vol20, 6) AS vol20, round(CASE WHEN down = 0 THEN CASE WHEN up = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi14,
  timezone('America/New_York', CAST(b.date AS TIMESTAMP) + INTERVAL '14 hours 30 minutes') AT TIME ZONE 'UTC' AS decision, found.period, weekly.value
FROM b LEFT JOIN y ON y.symbol = b.symbol AND y.pos = b.pos LEFT JOIN found ON found.symbol = b.symbol LEFT JOIN weekly ON weekly.period = found.period WHERE b.date = b.latest""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each symbol: averages, volatility, RSI, trend, and the weekly value that was public by then."""
    rows = regimes.trend_regime(day_returns(spark, sf_dir)).withColumn("vol20", indicators.realized_vol(c("ret")))
    rows = indicators.recursive(rows, {"rsi14": lambda g: indicators.rsi(g["close"].to_numpy(float))})
    rows = rows.withColumn("decision", pit.utc(c("date"), "14:30:00", "America/New_York"))
    series = weekly(spark, sf_dir).withColumn("available_at", pit.utc(F.next_day("period", "WED"), "10:30:00", "America/New_York"))
    latest = rows.withColumn("back", F.max("date").over(Window.partitionBy("symbol"))).filter("date = back").drop("back")
    out = pit.as_of_join(latest, series, "decision", "available_at", ["period", "value"], tie="period")
    return out.withColumns({x: F.round(x, n) for x, n in FLAGSHIP_DIGITS.items()})


register("bars", f"WITH {BARS} SELECT * FROM bars")(day_bars)
column("log_returns", lambda: c("ret"), "ret")
column("pct_change_20", lambda: indicators.pct_change(c("close"), 20), "close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1")
column("sma20", lambda: indicators.sma(c("close"), 20), guard(f"avg(close) {over(20)}", "close", 20), 4)
column("rolling_sd_sample", lambda: rolling(F.stddev_samp, c("ret"), 20, 16), guard(f"stddev_samp(ret) {over(20)}", "ret", 20, 16))
column("rolling_sd_pop", lambda: rolling(F.stddev_pop, c("close"), 20), guard(f"stddev_pop(close) {over(20)}", "close", 20), 3)
column("realized_vol", lambda: indicators.realized_vol(c("ret")), guard(f"stddev_samp(ret) {over(20)} * sqrt(252)", "ret", 20, 16))
column("rolling_min_max", lambda: F.max("high").over(trailing(50)) - F.min("low").over(trailing(50)), f"max(high) {over(50)} - min(low) {over(50)}", 4)
column("bollinger_pct_b", lambda: indicators.bollinger(c("close"))["pct_b"], guard(f"CASE WHEN stddev_pop(close) {over(20)} > 0 THEN (close - avg(close) {over(20)} + 2 * stddev_pop(close) {over(20)}) / (4 * stddev_pop(close) {over(20)}) END", "close", 20))
column("bollinger_bandwidth", lambda: indicators.bollinger(c("close"))["bandwidth"], guard(f"4 * stddev_pop(close) {over(20)} / avg(close) {over(20)}", "close", 20))
column("true_range", lambda: indicators.true_range(c("high"), c("low"), c("close")), "CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY date)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY date))) END", 4)
column("drawdown", lambda: indicators.drawdown(c("close")), f"close / max(close) {over()} - 1")
column("cum_returns_60", lambda: rolling(F.sum, c("ret"), 60, 36), guard(f"sum(ret) {over(60)}", "ret", 60, 36))
column("month_cyclical", lambda: F.sin(F.lit(2 * 3.141592653589793) * F.month("date") / 12) + 1, "sin(2 * 3.141592653589793 * month(date) / 12) + 1")  # from 0 to 2: no negative zero
column("weekday_monday_zero", lambda: F.weekday("date").cast("double"), "CAST(isodow(date) - 1 AS DOUBLE)")
column("volume_z20", lambda: rolling(F.avg, F.log("volume"), 20, 12), guard(f"avg(ln(volume)) {over(20)}", "volume", 20, 12))
column("range_pct_14", lambda: previous(rolling(F.avg, (c("high") - c("low")) / c("close"), 14, 8)), "lag(a) OVER (PARTITION BY symbol ORDER BY date)", view=f"(SELECT *, {guard(f'avg((high - low) / close) {over(14)}', 'close', 14, 8)} AS a FROM returns)")
for _h, _least in ((1, 1), (5, 3), (20, 10)):
    _ahead = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {_h} FOLLOWING)"
    column(
        f"forward_label_{_h}",
        lambda h=_h, least=_least: F.when((F.lead("date", h).over(ordered()).isNotNull()) & (F.count("ret").over(ordered().rowsBetween(1, h)) >= least), F.sum(F.coalesce("ret", F.lit(0.0))).over(ordered().rowsBetween(1, h))),
        f"CASE WHEN lead(date, {_h}) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL AND count(ret) {_ahead} >= {_least} THEN sum(coalesce(ret, 0)) {_ahead} END",
    )
column("ffill_every_seventh", lambda: F.last(F.when(c("pos") % 7 == 0, c("close")), ignorenulls=True).over(trailing(None)), f"last_value(CASE WHEN pos % 7 = 0 THEN close END IGNORE NULLS) {over()}", 4)
column("equity_curve", lambda: risk.equity(c("r")), f"product(1 + r) {over()}", source=simple_returns, head=SIMPLE, view="simple")
column("rolling_midrank", lambda: midrank(c("close"), 60, 30), "CASE WHEN len(v) >= 30 THEN 100.0 * (len(list_filter(v, lambda z: z < v[-1])) + 0.5 * (len(list_filter(v, lambda z: z = v[-1])) - 1)) / greatest(len(v) - 1, 1) END", view=f"(SELECT *, list(close) {over(60)} AS v FROM returns)")

RECURSIVE = """WITH RECURSIVE {head}, steps AS (SELECT symbol, date, pos, {x} AS v FROM returns), y(symbol, date, pos, v) AS (
  SELECT symbol, max(date), {first} + {n} - 1, avg(v) FROM steps WHERE pos BETWEEN {first} AND {first} + {n} - 1 GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT s.symbol, s.date, s.pos, y.v + {alpha} * (s.v - y.v) FROM y JOIN steps s ON s.symbol = y.symbol AND s.pos = y.pos + 1)
SELECT symbol, date, round(v, 4) AS x FROM y"""


def recursive_query(name: str, column_name: str, x: str, n: int, alpha: str, first: int = 1) -> None:
    @register(name, RECURSIVE.format(head=RETURNS, x=x, n=n, alpha=alpha, first=first))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = indicators.recursive_indicators(day_bars(spark, sf_dir)).filter(F.col(column_name).isNotNull())
        return out.select("symbol", "date", F.round(column_name, 4).alias("x"))


recursive_query("ema20", "ema20", "close", 20, "(2.0 / 21)")
recursive_query("wilder14", "wilder14", "close", 14, "(1.0 / 14)")
recursive_query("atr14", "atr14", "greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY date)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY date)))", 14, "(1.0 / 14)", 2)


@register("rsi_macd", f"""WITH RECURSIVE {RETURNS}, moves AS (SELECT symbol, pos, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS step FROM returns),
steps(kind, n, first, alpha, symbol, pos, v) AS (
  SELECT 'up', 14, 2, 1.0::DOUBLE / 14, symbol, pos, greatest(step, 0) FROM moves WHERE step IS NOT NULL UNION ALL SELECT 'down', 14, 2, 1.0::DOUBLE / 14, symbol, pos, greatest(-step, 0) FROM moves WHERE step IS NOT NULL
  UNION ALL SELECT 'fast', 12, 1, 2.0::DOUBLE / 13, symbol, pos, close FROM moves UNION ALL SELECT 'slow', 26, 1, 2.0::DOUBLE / 27, symbol, pos, close FROM moves),
y(kind, symbol, pos, v) AS (
  SELECT kind, symbol, max(pos), avg(v) FROM steps WHERE pos < first + n GROUP BY kind, symbol, n HAVING count(*) = n
  UNION ALL SELECT s.kind, s.symbol, s.pos, y.v + s.alpha * (s.v - y.v) FROM y JOIN steps s ON s.kind = y.kind AND s.symbol = y.symbol AND s.pos = y.pos + 1),
line AS (SELECT a.symbol, a.pos, a.v - b.v AS v FROM y a JOIN y b ON a.symbol = b.symbol AND a.pos = b.pos WHERE a.kind = 'fast' AND b.kind = 'slow'),
z(symbol, pos, v) AS (
  SELECT symbol, max(pos), avg(v) FROM line WHERE pos < 26 + 9 GROUP BY symbol HAVING count(*) = 9
  UNION ALL SELECT s.symbol, s.pos, z.v + 0.2::DOUBLE * (s.v - z.v) FROM z JOIN line s ON s.symbol = z.symbol AND s.pos = z.pos + 1)
SELECT r.symbol, r.date, round(CASE WHEN d.v = 0 THEN CASE WHEN u.v = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + u.v / d.v) END, 4) AS rsi14,
  round(line.v, 4) AS macd, round(z.v, 4) AS macd_signal, round(line.v - z.v, 4) AS macd_hist
FROM returns r LEFT JOIN y u ON u.kind = 'up' AND u.symbol = r.symbol AND u.pos = r.pos LEFT JOIN y d ON d.kind = 'down' AND d.symbol = r.symbol AND d.pos = r.pos
  LEFT JOIN line ON line.symbol = r.symbol AND line.pos = r.pos LEFT JOIN z ON z.symbol = r.symbol AND z.pos = r.pos""")
def rsi_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indicators.recursive_indicators(day_bars(spark, sf_dir))
    return out.select("symbol", "date", *[F.round(x, 4).alias(x) for x in ("rsi14", "macd", "macd_signal", "macd_hist")])


@register("trend_regime", f"""WITH {BARS}, s AS (
  SELECT symbol, date, close, {guard(f"avg(close) {over(50)}", "close", 50)} AS f, {guard(f"avg(close) {over(200)}", "close", 200)} AS s FROM bars),
t AS (SELECT *, lag(s, 20) OVER (PARTITION BY symbol ORDER BY date) AS b FROM s)
SELECT symbol, date, CASE WHEN b IS NULL THEN 'insufficient_data' WHEN close > f AND f > s AND s > b THEN 'uptrend' WHEN close < f AND f < s AND s < b THEN 'downtrend' ELSE 'range' END AS trend FROM t""")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.trend_regime(day_bars(spark, sf_dir)).select("symbol", "date", "trend")


@register("vol_regime", f"""WITH {RETURNS}, a AS (SELECT *, {guard(f"stddev_samp(ret) {over(20)} * sqrt(252)", "ret", 20, 16)} AS vol20 FROM returns),
b AS (SELECT *, list(vol20) FILTER (WHERE vol20 IS NOT NULL) {over(756)} AS v FROM a),
p AS (SELECT *, CASE WHEN len(v) >= 252 THEN 100.0::DOUBLE * (len(list_filter(v, lambda z: z < v[-1])) + 0.5::DOUBLE * (len(list_filter(v, lambda z: z = v[-1])) - 1)) / greatest(len(v) - 1, 1) END AS pct FROM b)
SELECT symbol, date, round(vol20, 6) AS vol20, round(pct, 6) AS vol_pctile,
  CASE WHEN pct IS NULL THEN 'insufficient_data' WHEN pct > 95 THEN 'extreme' WHEN pct > 75 THEN 'high' WHEN pct < 25 THEN 'low' ELSE 'normal' END AS vol_regime FROM p""")
def vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regimes.vol_regime(day_returns(spark, sf_dir))
    return out.select("symbol", "date", F.round("vol20", 6).alias("vol20"), F.round("vol_pctile", 6).alias("vol_pctile"), "vol_regime")


PIVOTS = f"""WITH {BARS}, f AS (SELECT *, count(*) OVER w AS n, max(high) OVER w AS h, min(low) OVER w AS l, lead(date, 5) OVER (PARTITION BY symbol ORDER BY date) AS confirmed_at
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT symbol, date, confirmed_at, 'high' AS kind, high AS price FROM f WHERE n = 11 AND high = h UNION ALL SELECT symbol, date, confirmed_at, 'low', low FROM f WHERE n = 11 AND low = l"""


@register("swing_pivots", PIVOTS)
def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.swing_pivots(day_bars(spark, sf_dir))


@register("support_resistance", f"""WITH RECURSIVE {RETURNS}, spans AS (
  SELECT symbol, pos, greatest(high - low, abs(high - b), abs(low - b)) AS v FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS b FROM returns) WHERE b IS NOT NULL),
y(symbol, pos, v) AS (
  SELECT symbol, max(pos), avg(v) FROM spans WHERE pos <= 15 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT s.symbol, s.pos, y.v + (1.0::DOUBLE / 14) * (s.v - y.v) FROM y JOIN spans s ON s.symbol = y.symbol AND s.pos = y.pos + 1),
piv AS ({PIVOTS}),
edge AS (SELECT symbol, min(date) AS since, max(date) AS as_of, arg_max(close, date) AS last, max(pos) AS pos FROM (SELECT *, max(pos) OVER (PARTITION BY symbol) AS top FROM returns) WHERE pos > top - 250 GROUP BY symbol),
sides AS (SELECT p.symbol, p.price, abs(p.price - e.last) AS far, CASE WHEN p.price < e.last THEN 'support' ELSE 'resistance' END AS side, 0.5::DOUBLE * y.v AS width
  FROM piv p JOIN edge e ON p.symbol = e.symbol LEFT JOIN y ON y.symbol = e.symbol AND y.pos = e.pos WHERE p.date >= e.since AND p.confirmed_at <= e.as_of AND p.price <> e.last),
near AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY far, price) AS n FROM sides),
walk(symbol, side, n, price, head, k) AS (
  SELECT symbol, side, n, price, price, 1 FROM near WHERE n = 1
  UNION ALL SELECT s.symbol, s.side, s.n, s.price, CASE WHEN abs(s.price - w.head) <= s.width THEN w.head ELSE s.price END, CASE WHEN abs(s.price - w.head) <= s.width THEN w.k ELSE w.k + 1 END
  FROM walk w JOIN near s ON s.symbol = w.symbol AND s.side = w.side AND s.n = w.n + 1)
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY side DESC, k) AS INT) AS rank, side, round(avg(price), 4) AS price, CAST(count(*) AS INT) AS touches FROM walk WHERE k <= 2 GROUP BY symbol, side, k""")
def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_bars(spark, sf_dir)
    return regimes.support_resistance(indicators.recursive_indicators(rows), regimes.swing_pivots(rows)).withColumn("price", F.round("price", 4))


def aggregate(name: str, value: Callable[[], Column], sql: str) -> None:
    register(name, f"WITH {SIMPLE} SELECT symbol, round({sql}, 6) AS x FROM simple GROUP BY symbol")(lambda spark, sf_dir: simple_returns(spark, sf_dir).groupBy("symbol").agg(F.round(value(), 6).alias("x")))


aggregate("annualized_return", lambda: risk.annualized_return(c("r")), "CASE WHEN product(1 + r) <= 0 THEN -1 ELSE pow(product(1 + r), 252.0 / count(r)) - 1 END")
aggregate("annualized_vol", lambda: risk.annualized_vol(c("r")), "stddev_samp(r) * sqrt(252)")
aggregate("sharpe", lambda: risk.sharpe(c("r")), "avg(r) / stddev_samp(r) * sqrt(252)")
aggregate("downside_dev", lambda: risk.downside_deviation(c("r")), "sqrt(avg(pow(least(r, 0), 2))) * sqrt(252)")
aggregate("sortino", lambda: risk.sortino(c("r")), "avg(r) * 252 / (sqrt(avg(pow(least(r, 0), 2))) * sqrt(252))")
aggregate("hit_rate", lambda: risk.hit_rate(c("r")), "avg(CASE WHEN r <> 0 THEN CAST(r > 0 AS INT) END)")
aggregate("var_hist", lambda: risk.var_historical(c("r")), "-quantile_cont(r, 0.05)")
register("cvar_hist", f"WITH {SIMPLE}, q AS (SELECT symbol, quantile_cont(r, 0.05) AS q FROM simple GROUP BY symbol) SELECT symbol, round(-avg(r), 6) AS x FROM simple JOIN q USING (symbol) WHERE r <= q GROUP BY symbol")(
    lambda spark, sf_dir: risk.cvar_historical(simple_returns(spark, sf_dir)).select("symbol", F.round("cvar", 6).alias("x"))
)
MDD = f"WITH {SIMPLE}, e AS (SELECT symbol, date, product(1 + r) {over()} AS e FROM simple), f AS (SELECT symbol, e / greatest(max(e) {over()}, 1) - 1 AS f FROM e)"
register("max_drawdown", f"{MDD} SELECT symbol, round(min(f), 6) AS x FROM f GROUP BY symbol")(lambda spark, sf_dir: risk.max_drawdown(simple_returns(spark, sf_dir)).select("symbol", F.round("max_drawdown", 6).alias("x")))
register("calmar", f"{MDD} SELECT a.symbol, round(a.g / abs(b.m), 5) AS x FROM (SELECT symbol, pow(product(1 + r), 252.0 / count(r)) - 1 AS g FROM simple GROUP BY symbol) a JOIN (SELECT symbol, min(f) AS m FROM f GROUP BY symbol) b USING (symbol)")(
    lambda spark, sf_dir: risk.summary(simple_returns(spark, sf_dir)).select("symbol", F.round("calmar", 5).alias("x"))
)


@register("beta", f"WITH {SIMPLE} SELECT a.symbol, round(covar_samp(a.r, b.r) / var_samp(b.r), 6) AS x FROM simple a JOIN simple b ON a.date = b.date AND b.symbol = 'O' GROUP BY a.symbol")
def beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simple_returns(spark, sf_dir)
    market = rows.filter("symbol = 'O'").select("date", c("r").alias("m"))
    return risk.beta(rows.join(market, "date")).select("symbol", F.round("beta", 6).alias("x"))


@register("position_size", f"""WITH {SIMPLE}, v AS (SELECT symbol, stddev_samp(r) * sqrt(252) AS vol, count(r) AS n FROM simple GROUP BY symbol)
SELECT symbol, round(CASE WHEN n < 252 THEN 0 ELSE least(0.2 / vol, 0.25, 1.0) END, 6) AS fraction, CASE WHEN n < 252 THEN 'min_history_days' WHEN 0.2 / vol <= 0.25 THEN 'vol_target' ELSE 'max_position_fraction' END AS binding FROM v
UNION ALL SELECT 'nan', 0, 'invalid_vol' UNION ALL SELECT 'infinite', 0, 'invalid_vol' UNION ALL SELECT 'stopped', 0, 'max_drawdown_stop' UNION ALL SELECT 'new', 0, 'min_history_days' """)
def position_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simple_returns(spark, sf_dir).groupBy("symbol").agg(risk.annualized_vol(c("r")).alias("vol"), F.count("r").alias("history_days"), F.lit(0.0).alias("strategy_drawdown"))
    bad = [("nan", float("nan"), 300, 0.0), ("infinite", float("inf"), 300, None), ("stopped", 0.1, 300, -0.4), ("new", 0.1, 10, -0.4)]
    rows = rows.unionByName(spark.createDataFrame(bad, "symbol string, vol double, history_days long, strategy_drawdown double"))
    return risk.position_size(rows).select("symbol", F.round("fraction", 6).alias("fraction"), "binding")


MONTHLY = RETURNS + ", monthly AS (SELECT symbol, last_day(date) AS month_end, sum(ret) AS ret FROM returns GROUP BY 1, 2 HAVING count(ret) / count(*) >= 0.8 AND count(ret) > 0)"
register("monthly_returns", f"WITH {MONTHLY} SELECT symbol, month_end, round(ret, 6) AS ret FROM monthly")(lambda spark, sf_dir: fundamentals.monthly_returns(day_returns(spark, sf_dir)).withColumn("ret", F.round("ret", 6)))
register("month_stats", f"WITH {MONTHLY} SELECT symbol, month(month_end) AS month, count(ret) AS n, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(avg(CAST(ret > 0 AS INT)), 6) AS hit_rate, round(CASE WHEN count(ret) > 1 THEN avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) END, 5) AS t_stat, min(year(month_end)) AS first_year, max(year(month_end)) AS last_year FROM monthly GROUP BY 1, 2")(
    lambda spark, sf_dir: fundamentals.month_stats(fundamentals.monthly_returns(day_returns(spark, sf_dir))).select("symbol", "month", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("hit_rate", 6).alias("hit_rate"), F.round("t_stat", 5).alias("t_stat"), "first_year", "last_year")
)
BAND = WEEKLY + """, keyed AS (SELECT *, year(period) AS y, least(weekofyear(period), 52) AS w FROM weekly), yearly AS (SELECT y, w, arg_max(value, period) AS v FROM keyed GROUP BY 1, 2),
band AS (SELECT k.period, k.value, avg(p.v) AS band_avg, min(p.v) AS band_min, max(p.v) AS band_max, count(p.v) AS band_n FROM keyed k LEFT JOIN yearly p ON p.w = k.w AND p.y BETWEEN k.y - 5 AND k.y - 1 GROUP BY 1, 2)"""
register("seasonal_band", f"WITH {BAND} SELECT period, value, round(band_avg, 4) AS band_avg, band_min, band_max, band_n FROM band")(lambda spark, sf_dir: fundamentals.seasonal_band(weekly(spark, sf_dir)).withColumn("band_avg", F.round("band_avg", 4)))
register("inventory_vs_seasonal", f"WITH {BAND} SELECT period, round(value - band_avg, 4) AS dev, round((value - band_avg) / band_avg, 6) AS dev_pct, round(CASE WHEN band_max > band_min THEN (value - band_min) / (band_max - band_min) END, 6) AS band_pos FROM band")(
    lambda spark, sf_dir: fundamentals.inventory(weekly(spark, sf_dir)).select("period", F.round("dev", 4).alias("dev"), F.round("dev_pct", 6).alias("dev_pct"), F.round("band_pos", 6).alias("band_pos"))
)
POSITIONS = "SELECT l_returnflag AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) + 1 AS date, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS long, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS short, sum(l_quantity) AS open_interest FROM lineitem GROUP BY 1, 2"


@register("net_positioning", f"WITH p AS ({POSITIONS}) SELECT symbol, date, round(long - short, 4) AS net, round((long - short) / open_interest, 6) AS share, round(long - short - lag(long - short) OVER (PARTITION BY symbol ORDER BY date), 4) AS change FROM p")
def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("symbol"), F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 1).alias("date"))
    side = lambda s: F.sum(F.when(c("l_linestatus") == s, c("l_quantity")).otherwise(0.0))
    out = fundamentals.positioning(rows.agg(side("O").alias("long"), side("F").alias("short"), F.sum("l_quantity").alias("open_interest")))
    return out.select("symbol", "date", F.round("net", 4).alias("net"), F.round("share", 6).alias("share"), F.round("change", 4).alias("change"))


@register("three_leg_spread", f"WITH {BARS} SELECT a.date, round((2 * b.close * 42 + c.close * 42 - 3 * a.close) / 3, 4) AS spread FROM bars a JOIN bars b ON b.date = a.date AND b.symbol = 'O' JOIN bars c ON c.date = a.date AND c.symbol = 'P' WHERE a.symbol = 'F'")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = day_bars(spark, sf_dir).groupBy("date").pivot("symbol", ["F", "O", "P"]).agg(F.max("close"))
    return fundamentals.spread_321(legs.select("date", c("F").alias("cl"), c("O").alias("rb"), c("P").alias("ho"))).withColumn("spread", F.round("spread", 4))


@register("percentile_last", f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS b FROM bars), l AS (SELECT *, arg_max(close, date) OVER (PARTITION BY symbol) AS z FROM r WHERE b <= 252) SELECT symbol, round(100.0 * (count(*) FILTER (WHERE close < z) + 0.5 * (count(*) FILTER (WHERE close = z) - 1)) / (count(*) - 1), 6) AS pctile FROM l GROUP BY symbol HAVING count(*) > 1")
def last_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals.percentile_last(day_bars(spark, sf_dir).select("symbol", "date", c("close").alias("x")), 252).withColumn("pctile", F.round("pctile", 6))


CURVE = "curve AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(DATE '2020-01-01' + CAST(l_linenumber AS INT) * 30 AS DATE) AS expiry, avg(l_extendedprice) AS settle FROM lineitem GROUP BY 1, 2)"


@register("curve_metrics", f"""WITH {CURVE}, s AS (SELECT *, row_number() OVER w AS place, lead(settle) OVER w AS nxt, lead(expiry) OVER w AS ne FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY expiry))
SELECT symbol, round(max(settle - nxt) FILTER (WHERE place = 1), 4) AS m1_m2, round(max(ln(settle / nxt) / (date_diff('day', expiry, ne) / 365.25)) FILTER (WHERE place = 1), 6) AS roll_yield, round(arg_min(settle, expiry) - arg_max(settle, expiry), 4) AS front_back,
CASE WHEN bool_and(coalesce(abs(nxt / settle - 1) <= 0.001, true)) THEN 'flat' WHEN bool_and(coalesce(nxt / settle - 1 <= 0.001, true)) THEN 'backwardation' WHEN bool_and(coalesce(nxt / settle - 1 >= -0.001, true)) THEN 'contango' ELSE 'mixed' END AS shape FROM s GROUP BY symbol""")
def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    settles = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.expr("date_add(DATE '2020-01-01', l_linenumber * 30)").alias("expiry")).agg(F.avg("l_extendedprice").alias("settle"))
    return fundamentals.curve_metrics(settles).select("symbol", F.round("m1_m2", 4).alias("m1_m2"), F.round("roll_yield", 6).alias("roll_yield"), F.round("front_back", 4).alias("front_back"), "shape")


# point in time
AVAILABLE = WEEKLY + """, avail AS (SELECT period, value, timezone('America/New_York', CAST(period + 5 AS TIMESTAMP) + INTERVAL '10 hours 30 minutes') AT TIME ZONE 'UTC' AS available_at FROM weekly),
sessions AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '14 hours 30 minutes') AT TIME ZONE 'UTC' AS t FROM orders)"""


def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).withColumn("available_at", pit.utc(F.next_day("period", "WED"), "10:30:00", "America/New_York"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.withColumn("t", pit.utc(c("date"), "14:30:00", "America/New_York"))


@register("release_timestamp_utc", f"WITH {AVAILABLE} SELECT period, strftime(available_at, '%Y-%m-%d %H:%M:%S') AS available_at FROM avail")
def release_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(spark, sf_dir).select("period", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))


@register("asof_backward_release", f"WITH {AVAILABLE} SELECT strftime(s.date, '%Y-%m-%d') AS date, coalesce(strftime(a.period, '%Y-%m-%d'), '') AS period, coalesce(a.value, -1) AS value FROM sessions s ASOF LEFT JOIN avail a ON s.t >= a.available_at")
def asof_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.as_of_join(decisions(spark, sf_dir), available(spark, sf_dir), "t", "available_at", ["period", "value"], tie="period")
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce(F.date_format("period", "yyyy-MM-dd"), F.lit("")).alias("period"), F.coalesce("value", F.lit(-1.0)).alias("value"))


LATE = "late AS (SELECT period, value, CASE WHEN period BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' THEN greatest(available_at, TIMESTAMP '1997-07-01 20:00:00') ELSE available_at END AS available_at FROM avail)"


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.apply_overrides(available(spark, sf_dir), [(dt.date(1997, 3, 1), dt.date(1997, 5, 31), dt.datetime(1997, 7, 1, 20))])


register("release_overrides", f"WITH {AVAILABLE}, {LATE} SELECT strftime(period, '%Y-%m-%d') AS period, strftime(available_at, '%Y-%m-%d %H:%M:%S') AS available_at FROM late")(
    lambda spark, sf_dir: late(spark, sf_dir).select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))
)


@register("asof_tie_break", f"WITH {AVAILABLE}, {LATE}, one AS (SELECT available_at, max(period) AS period FROM late GROUP BY 1) SELECT strftime(s.date, '%Y-%m-%d') AS date, coalesce(strftime(a.period, '%Y-%m-%d'), '') AS period FROM sessions s ASOF LEFT JOIN one a ON s.t >= a.available_at")
def asof_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.as_of_join(decisions(spark, sf_dir), late(spark, sf_dir), "t", "available_at", ["period"], tie="period")
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce(F.date_format("period", "yyyy-MM-dd"), F.lit("")).alias("period"))


@register("asof_latest_period", f"WITH {AVAILABLE}, {LATE} SELECT strftime(s.date, '%Y-%m-%d') AS date, coalesce(strftime(max(a.period), '%Y-%m-%d'), '') AS period FROM sessions s LEFT JOIN late a ON a.available_at <= s.t GROUP BY s.date")
def asof_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.as_of_join(decisions(spark, sf_dir), late(spark, sf_dir), "t", "available_at", ["period"], tie="period", order_by="period")
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce(F.date_format("period", "yyyy-MM-dd"), F.lit("")).alias("period"))


# backtests
@register("backtest_sma", f"""WITH {BARS}, t AS (SELECT *, CASE WHEN count(close) {over(200)} >= 200 THEN CASE WHEN avg(close) {over(50)} > avg(close) {over(200)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS target, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
p AS (SELECT *, coalesce(last_value(target IGNORE NULLS) {over()}, 0::DOUBLE) AS pend FROM t), q AS (SELECT *, coalesce(lag(pend) OVER w, 0::DOUBLE) AS pos FROM p WINDOW w AS (PARTITION BY symbol ORDER BY date)),
h AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY date), 0::DOUBLE) AS held FROM q),
f AS (SELECT *, CASE WHEN pc IS NULL THEN 1 ELSE (1 + held * (open / pc - 1)) * (1 - abs(pos - held) * 0.001) * (1 + pos * (close / open - 1)) END AS f FROM h)
SELECT symbol, date, pos AS position, pos - held AS trade, round(ln(product(f) {over()}), 5) AS log_equity FROM f""")
def backtest_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backtest.run(backtest.sma_targets(day_bars(spark, sf_dir)).withColumn("roll", F.lit(False)))
    return out.select("symbol", "date", "position", "trade", F.round(F.log("equity"), 5).alias("log_equity"))


EXCESS = ("total_return", "cagr", "vol", "sharpe", "max_drawdown")


@register("backtest_metrics", f"""WITH {BARS}, t AS (
  SELECT *, lag(close) OVER w AS pc, CASE WHEN row_number() OVER w = 1 THEN 1.0::DOUBLE END AS hold,
    CASE WHEN count(close) {over(200)} >= 200 THEN CASE WHEN avg(close) {over(50)} > avg(close) {over(200)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS crossed
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
u AS (SELECT 's' AS kind, crossed AS target, * FROM t UNION ALL SELECT 'b', hold, * FROM t),
p AS (SELECT *, coalesce(last_value(target IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0::DOUBLE) AS pend, row_number() OVER w AS n FROM u WINDOW w AS (PARTITION BY kind, symbol ORDER BY date)),
q AS (SELECT *, coalesce(lag(pend) OVER w, 0::DOUBLE) AS pos, coalesce(lag(pend, 2) OVER w, 0::DOUBLE) AS held FROM p WINDOW w AS (PARTITION BY kind, symbol ORDER BY date)),
f AS (SELECT *, CASE WHEN pc IS NULL THEN 1 ELSE (1 + held * (open / pc - 1)) * (1 - abs(pos - held) * 0.001) * (1 + pos * (close / open - 1)) END AS f FROM q),
e AS (SELECT *, product(f) OVER (PARTITION BY kind, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM f),
d AS (SELECT *, f - 1 AS r, equity / greatest(1, max(equity) OVER (PARTITION BY kind, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS fall FROM e),
m AS (SELECT kind, symbol, product(1 + r) - 1 AS total_return, pow(product(1 + r), 252.0::DOUBLE / count(*)) - 1 AS cagr, stddev_samp(r) * sqrt(252) AS vol,
    avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, min(fall) AS max_drawdown FROM d WHERE n > 1 GROUP BY kind, symbol)
SELECT s.symbol, {", ".join(f"round(s.{x} - b.{x}, 5) AS {x}" for x in EXCESS)} FROM m s JOIN m b ON s.symbol = b.symbol WHERE s.kind = 's' AND b.kind = 'b'""")
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest.sma_targets(day_bars(spark, sf_dir)).withColumn("roll", F.lit(False))
    out = backtest.excess(backtest.metrics(backtest.run(rows)), backtest.metrics(backtest.run(backtest.buy_and_hold(rows))), EXCESS)
    return out.select("symbol", *[F.round(x, 5).alias(x) for x in EXCESS])


# quality and rolls
register("q_repeated_close", f"WITH {BARS}, s AS (SELECT *, coalesce(o = lag(o) OVER w, false) AS same FROM (SELECT symbol, date, floor(close / 20000) AS o FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY date)), r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) {over()} AS run FROM s) SELECT symbol, min(date) AS date, CAST(count(*) + 1 AS DOUBLE) AS detail FROM r WHERE same GROUP BY symbol, run HAVING count(*) + 1 >= 4")(
    lambda spark, sf_dir: quality.repeated_close(day_bars(spark, sf_dir).withColumn("close", F.floor(c("close") / 20000))).select("symbol", "date", "detail")
)
register("q_outlier_mad", f"WITH {RETURNS}, m AS (SELECT symbol, median(ret) AS mid, count(ret) AS n FROM returns GROUP BY symbol), d AS (SELECT symbol, median(abs(ret - mid)) AS mad FROM returns JOIN m USING (symbol) GROUP BY symbol) SELECT r.symbol, r.date, round(r.ret, 6) AS detail FROM returns r JOIN m USING (symbol) JOIN d USING (symbol) WHERE n > 30 AND mad > 0 AND abs(ret) > 3 * 1.4826 * mad")(
    lambda spark, sf_dir: quality.outliers(day_returns(spark, sf_dir), 3.0).select("symbol", "date", F.round("detail", 6).alias("detail"))
)
register("q_split_suspect", f"WITH {RETURNS} SELECT DISTINCT symbol, date, round(exp(ret), 5) AS detail FROM returns, (VALUES (2), (3), (4), (5), (8), (10), (20), (25), (50)) AS v(n) WHERE abs(exp(ret) / n - 1) <= 0.02 OR abs(exp(ret) * n - 1) <= 0.02")(
    lambda spark, sf_dir: quality.split_suspects(day_returns(spark, sf_dir)).select("symbol", "date", F.round("detail", 5).alias("detail"))
)
register("q_ohlc_nonpositive", f"WITH {BARS} SELECT symbol, date FROM bars WHERE close - 30000 <= 0")(lambda spark, sf_dir: quality.nonpositive_price(day_bars(spark, sf_dir).withColumn("close", c("close") - 30000)).select("symbol", "date"))
column("volume_jump", lambda: rolls.volume_jump(), "volume / nullif(lag(volume) OVER (PARTITION BY symbol ORDER BY date), 0)")
closed_days.add(day_bars)

# text, JSON, log
# the other engine has no look-behind: what may not be glued to a number is taken in front of it, with a space before the text
WRITTEN = f"(?i:({text.YEAR_CONTEXT}))?([^{text.GLUE}])({text.SIGN})({text.CURRENCY})({text.DIGITS})({text.SUFFIX})(?i:({text.DURATION}))?".replace(r"−", r"\x{2212}")
MASKED = "|".join(text.MASKS).replace("{", "{{").replace("}", "}}")
MENTIONS = rf"""masked AS (SELECT {{key}}, unnest(regexp_extract_all(regexp_replace(concat(' ', {{text}}), '{MASKED}', ' ', 'g'), '{WRITTEN.replace("{", "{{").replace("}", "}}")}', 0)) AS raw FROM {{source}}),
parts AS (SELECT *, {", ".join(f"regexp_extract(raw, '^{WRITTEN.replace('{', '{{').replace('}', '}}')}$', {k}) AS {n}" for k, n in ((1, "context"), (3, "sign"), (4, "currency"), (5, "number"), (6, "suffix"), (7, "duration")))} FROM masked),
read AS (SELECT *, lower(trim(suffix)) AS low, CAST(replace(number, ',', '') AS DOUBLE) AS v FROM parts),
meant AS (SELECT *, v / CASE WHEN low IN ('bp', 'bps') THEN 100 ELSE 1 END AS value, length(regexp_extract(number, '\.([0-9]+)', 1)) + CASE WHEN low IN ('bp', 'bps') THEN 2 ELSE 0 END AS decimals, low IN ('%', 'bp', 'bps') AS percent,
  CASE WHEN low = 'k' THEN 1e3 WHEN low IN ('m', 'mm', 'mn') THEN 1e6 WHEN low IN ('b', 'bn') THEN 1e9 WHEN low IN ('t', 'tn') THEN 1e12 ELSE 1 END::DOUBLE AS scale, low IN ('st', 'nd', 'rd', 'th') AS ordinal FROM read),
plain AS (SELECT *, decimals = 0 AND currency = '' AND (ordinal OR (NOT percent AND scale = 1 AND NOT contains(lower(number), 'e'))) AS plain FROM meant),
mentions AS (SELECT * FROM plain WHERE low NOT IN ('d', 'w', 'y', 'wk', 'mo', 'yr', 'yrs', 'h', 'q') AND NOT (plain AND value < 13 AND (low = '' OR ordinal)) AND NOT (plain AND duration <> '') AND NOT (plain AND value BETWEEN 1900 AND 2100 AND context <> ''))"""
register("number_claims", f"WITH {MENTIONS.format(key='doc_id', text='text', source='documents')} SELECT doc_id, trim(concat(sign, currency, number, suffix)) AS raw, value, CAST(decimals AS INT) AS decimals, percent, scale FROM mentions")(lambda spark, sf_dir: text.claims(table(spark, sf_dir, "documents"), "text", "doc_id"))

# facts of parts as tool results, and sentences about them that are right, wrong, uncited or cite what is not there
@register("check_text", """SELECT p_partkey, 'not_found' AS problem, concat(printf('%.2f', p_size / 4), '%') AS raw FROM part
UNION ALL SELECT p_partkey, 'uncited', NULL FROM part UNION ALL SELECT p_partkey, 'unknown_citation', 'T9' FROM part""")
def check_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    price = F.format_string("%.2f", "p_retailprice")
    said = F.concat(
        F.lit("Price is $"), price, F.lit(" [T1]. Size "), c("p_size").cast("string"), F.lit(" of year 2019 [T1]; off by "), F.format_string("%.2f", c("p_size") / 4), F.lit("% [T1]. Costs "),
        F.format_string("%.1f", c("p_retailprice") / 1000), F.lit("k [T2]! It sold 426k without a source. See "), price, F.lit(" [T9]"),
    )
    facts = parts.select("p_partkey", F.explode(F.array(
        F.struct(F.lit("T1").alias("result_id"), F.to_json(F.struct(c("p_retailprice").alias("price"), F.struct("p_size").alias("more"))).alias("payload")),
        F.struct(F.lit("T2").alias("result_id"), F.to_json(F.struct(F.array("p_retailprice").alias("prices"))).alias("payload")),
    )).alias("_f")).select("p_partkey", "_f.*")
    found = text.check_text(parts.select("p_partkey", said.alias("said")), "said", text.tool_values(facts, "p_partkey"), "p_partkey")
    return found.select("p_partkey", "problem", "raw")
register("sentence_split", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]\s+|\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS n FROM documents")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(c("text"))).alias("n")))
register("normalised_text", "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark")(lambda spark, sf_dir: table(spark, sf_dir, "benchmark").select("item_id", text.normalised(c("text")).alias("t")))
register("json_path_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))
register("html_title_extract", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages")(lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a [^>]*href="), F.lit(0))).alias("links")))


@register("run_summary", """SELECT CAST(user_id AS VARCHAR) AS run, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS llm_calls, count(*) FILTER (WHERE event_type = 'purchase') AS tool_calls, count(*) FILTER (WHERE value > 100) AS errors,
  round(sum(value), 2) AS cost, CAST(sum(event_id % 10) AS BIGINT) AS tokens, arg_max(event_type, event_id) FILTER (WHERE event_type = 'purchase') AS rating FROM events GROUP BY 1""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = c("event_type") == "purchase"
    kind = F.when(c("event_type").isin("view", "click"), "llm").when(bought, "tool").otherwise("note")
    log = table(spark, sf_dir, "events").select(c("user_id").cast("string").alias("run"), c("event_id").alias("seq"), kind.alias("kind"), F.when(c("value") > 100, "too dear").alias("error"), c("value").alias("cost"), (c("event_id") % 10).alias("tokens"), F.when(bought, c("event_type")).alias("rating"))
    return reports.run_summaries(log, None).withColumn("cost", F.round("cost", 2))


register("rating_from_score", "SELECT c_custkey, CASE WHEN s >= 0.45 THEN 'strong_buy' WHEN s >= 0.15 THEN 'buy' WHEN s <= -0.45 THEN 'strong_sell' WHEN s <= -0.15 THEN 'sell' ELSE 'hold' END AS rating FROM (SELECT c_custkey, c_acctbal / 10000 AS s FROM customer)")(lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", regimes.rating(c("c_acctbal") / 10000).alias("rating")))


# features, folds and forecasts
FEATURES = ("r1", "cum_5", "cum_20", "cum_60", "vol_5", "vol_20", "vol_60", "vol_ratio_5_60", "dist_sma20", "dist_sma50", "dd_252")


def rolled(f: str, n: int, least: int, x: str = "ret") -> str:
    return guard(f"{f}({x}) {over(n)}", x, n, least)


@register("features_wide", f"""WITH {RETURNS}, l AS (SELECT *, exp(sum(coalesce(ret, 0)) {over()}) AS level FROM returns), f AS (SELECT symbol, date, ret AS r1,
  {rolled("sum", 5, 3)} AS cum_5, {rolled("sum", 20, 12)} AS cum_20, {rolled("sum", 60, 36)} AS cum_60, {rolled("stddev_samp", 5, 3)} AS vol_5, {rolled("stddev_samp", 20, 12)} AS vol_20, {rolled("stddev_samp", 60, 36)} AS vol_60,
  level / {rolled("avg", 20, 20, "level")} - 1 AS dist_sma20, level / {rolled("avg", 50, 50, "level")} - 1 AS dist_sma50, level / {rolled("max", 252, 60, "level")} - 1 AS dd_252 FROM l)
SELECT symbol, date, {", ".join(f"round({x}, 5) AS {x}" for x in FEATURES if x != "vol_ratio_5_60")}, round(vol_5 / vol_60, 5) AS vol_ratio_5_60 FROM f""")
def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.price_features(day_returns(spark, sf_dir)).select("symbol", "date", *[F.round(x, 5).alias(x) for x in FEATURES])


@register("dataset_asof_features")
def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, the weekly value that was public at each decision with its age, and labels."""
    rows = features.with_labels(features.with_recursive(features.price_features(day_returns(spark, sf_dir)))).withColumn("t", pit.utc(c("date"), "14:30:00", "America/New_York"))
    series = fundamentals.inventory(weekly(spark, sf_dir)).withColumn("available_at", pit.utc(F.next_day("period", "WED"), "10:30:00", "America/New_York"))
    out = pit.as_of_join(rows, series, "t", "available_at", ["period", "dev_pct", "band_pos", "available_at"], tie="period")
    return out.withColumn("age_days", F.datediff("date", F.to_date("available_at"))).drop("t", "available_at", "level")


@register("feature_leaks", "SELECT CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS column WHERE false")
def feature_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row: features of a prefix are the prefix of the features."""
    return features.leaks(features.price_features, day_returns(spark, sf_dir), F.lit("1998-06-30").cast("date"), list(FEATURES))


def all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_returns(spark, sf_dir).select("symbol", (c("pos") - 1).alias("pos"), (c("ret") / 50).alias("ret"))


SERIES = RETURNS + ", s AS (SELECT symbol, pos - 1 AS pos, ret / 50 AS ret FROM returns)"
FOLDS = """starts AS (SELECT symbol, n, CAST(g AS BIGINT) AS start FROM (SELECT symbol, count(*) AS n FROM s GROUP BY 1) e, generate_series(756, n - 1, 20) t(g)),
rows AS (SELECT symbol, start - 6 AS train_end, CAST(p AS BIGINT) AS pos FROM starts, generate_series(start, least(start + 19, n - 1)) t(p) WHERE p % 5 = 0),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY train_end DESC) AS back FROM rows),
folds AS (SELECT symbol, CAST(max(back) OVER (PARTITION BY symbol) - back AS INT) AS fold, train_end, pos FROM ranked WHERE back <= 30)"""
SUMS5 = "sums AS (SELECT symbol, pos, CASE WHEN count(ret) OVER w >= 3 THEN sum(ret) OVER w END AS s FROM s WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
EMPIRICAL = SUMS5 + """, q AS (SELECT f.symbol, f.fold, f.pos, quantile_cont(x.s, 0.1) AS a, quantile_cont(x.s, 0.5) AS b, quantile_cont(x.s, 0.9) AS d, avg(CAST(x.s > 0 AS INT)) AS up
  FROM folds f JOIN sums x ON x.symbol = f.symbol AND x.pos <= f.pos AND x.pos > f.pos - 756 AND x.s IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 252),
preds AS (SELECT symbol, 'naive' AS model, fold, pos, a - b AS q10, b - b AS q50, d - b AS q90, 0.5::DOUBLE AS p_up FROM q UNION ALL SELECT symbol, 'drift', fold, pos, a, b, d, up FROM q)"""
LABEL5 = """y AS (SELECT symbol, pos, CASE WHEN lead(pos, 5) OVER (PARTITION BY symbol ORDER BY pos) IS NOT NULL AND count(ret) OVER w >= 3 THEN sum(coalesce(ret, 0)) OVER w END AS y
  FROM s WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
LOSSES = "losses AS (SELECT *, (greatest(0.1 * (y - q10), -0.9 * (y - q10)) + greatest(0.5 * (y - q50), -0.5 * (y - q50)) + greatest(0.9 * (y - q90), -0.1 * (y - q90))) / 3 AS loss FROM preds JOIN y USING (symbol, pos) WHERE y IS NOT NULL)"


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fold_table(all_series(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))


def empirical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.empirical(origins(spark, sf_dir).select("symbol", "fold", "pos"), all_series(spark, sf_dir), 5)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.losses(empirical(spark, sf_dir), evaluate.labels(all_series(spark, sf_dir), 5))


register("fold_plan", f"WITH {SERIES}, {FOLDS} SELECT symbol, fold, train_end, pos FROM folds")(origins)


@register("empirical_quantiles", f"""WITH {SERIES}, {FOLDS}, {EMPIRICAL}
SELECT symbol, model, fold, pos, round(q10, 6) + 0 AS q10, round(q50, 6) + 0 AS q50, round(q90, 6) + 0 AS q90, round(p_up, 6) AS p_up FROM preds""")
def empirical_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [(F.round(x, 6) + 0).alias(x) for x in ("q10", "q50", "q90")]
    return empirical(spark, sf_dir).select("symbol", "model", "fold", "pos", *rounded, F.round("p_up", 6).alias("p_up"))


register("pinball_loss", f"WITH {SERIES}, {FOLDS}, {EMPIRICAL}, {LABEL5}, {LOSSES} SELECT symbol, model, pos, round(loss, 6) AS loss FROM losses")(
    lambda spark, sf_dir: scored(spark, sf_dir).select("symbol", "model", "pos", F.round("loss", 6).alias("loss"))
)
BOARD = f"WITH {SERIES}, {FOLDS}, {EMPIRICAL}, {LABEL5}, {LOSSES}, base AS (SELECT symbol, pos, loss AS base_loss, q50 AS base_mid FROM losses WHERE model = 'naive')"


@register("leaderboard_scores", f"""{BOARD} SELECT symbol, model, count(*) AS n, round(avg(abs(y - q50)), 6) AS mae, round(avg(abs(y - q50)) / avg(abs(y - base_mid)), 6) AS mase, round(avg(loss), 6) AS pinball,
  round(1 - avg(loss) / avg(base_loss), 5) + 0 AS skill, round(avg(CAST(y BETWEEN q10 AND q90 AS INT)), 6) AS coverage, round(avg(pow(p_up - CAST(y > 0 AS INT), 2)), 6) AS brier FROM losses JOIN base USING (symbol, pos) GROUP BY 1, 2""")
def leaderboard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = evaluate.leaderboard(scored(spark, sf_dir), 5, 12)
    return board.select("symbol", "model", "n", *[(F.round(x, 5 if x == "skill" else 6) + 0).alias(x) for x in ("mae", "mase", "pinball", "skill", "coverage", "brier")])


@register("block_means_t", f"""{BOARD}, d AS (SELECT l.symbol, l.pos, loss - base_loss AS d, row_number() OVER (PARTITION BY l.symbol ORDER BY l.pos) - 1 AS i, count(*) OVER (PARTITION BY l.symbol) AS n
  FROM losses l JOIN base USING (symbol, pos) WHERE model = 'drift'),
m AS (SELECT symbol, avg(d) AS m FROM d WHERE i // 12 < n // 12 GROUP BY symbol, i // 12)
SELECT symbol, count(*) AS blocks, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) AS t FROM m GROUP BY symbol""")
def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    base = rows.filter("model = 'naive'").select("symbol", "pos", c("loss").alias("base"))
    diffs = rows.filter("model = 'drift'").join(base, ["symbol", "pos"]).select("symbol", "model", "pos", (c("loss") - c("base")).alias("d"))
    return evaluate.block_test(diffs, ["symbol", "model"], 12).select("symbol", c("blocks").cast("long").alias("blocks"), F.round("t", 4).alias("t"))


@register("walk_forward_leaderboard")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboards of all symbols in one plan."""
    return forecast.walk_forward(all_series(spark, sf_dir), 5)


@register("threshold_signal", f"WITH {SERIES}, {FOLDS}, {EMPIRICAL} SELECT symbol, pos, CASE WHEN p_up >= 0.55 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM preds WHERE model = 'drift'")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return empirical(spark, sf_dir).filter("model = 'drift'").select("symbol", "pos", backtest.threshold_targets(c("p_up")).alias("target"))


@register("snapshot_latest")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested row a symbol: price, technicals, regimes, levels, risk, seasonality and the public weekly value."""
    rows = regimes.vol_regime(regimes.trend_regime(day_returns(spark, sf_dir)))
    rows = indicators.recursive_indicators(rows.withColumn("change_1d", F.expm1("ret"))).withColumn("change_20d", indicators.pct_change(c("close"), 20)).withColumn("high_252", F.max("high").over(trailing(252))).withColumn("low_252", F.min("low").over(trailing(252)))
    latest = F.max_by(F.struct("date", "close", "change_1d", "change_20d", "high_252", "low_252"), "date").alias("price")
    technicals = F.max_by(F.struct("sma_fast", "sma_slow", "rsi14", "macd_hist", "atr14", "trend", "vol20", "vol_pctile", "vol_regime"), "date").alias("technicals")
    out = rows.groupBy("symbol").agg(latest, technicals)
    simple = simple_returns(spark, sf_dir).withColumn("back", F.row_number().over(newest_first())).filter("back <= 252").drop("back")
    risks = risk.summary(simple)
    ended = fundamentals.monthly_returns(day_returns(spark, sf_dir)).join(rows.groupBy("symbol").agg(F.max("date").alias("_last")), "symbol").filter("month_end < _last")
    month = fundamentals.month_stats(ended)
    near = regimes.support_resistance(rows, regimes.swing_pivots(day_bars(spark, sf_dir))).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("side", "rank", "price", "touches"))).alias("levels"))
    out = out.join(risks.select("symbol", F.struct(*[x for x in risks.columns if x != "symbol"]).alias("risk")), "symbol", "left").join(near, "symbol", "left")
    season = month.select(c("symbol").alias("_s"), "month", F.struct(*[x for x in month.columns if x != "symbol"]).alias("seasonality"))
    out = out.join(season, (c("symbol") == c("_s")) & (F.month("price.date") == c("month")), "left").drop("_s", "month").withColumn("t", pit.utc(c("price.date"), "14:30:00", "America/New_York"))
    series = fundamentals.inventory(weekly(spark, sf_dir)).withColumn("available_at", pit.utc(F.next_day("period", "WED"), "10:30:00", "America/New_York")).withColumn("inventory", F.struct("period", "value", "dev", "dev_pct", "band_pos"))
    return pit.as_of_join(out, series, "t", "available_at", ["period", "inventory"], tie="period", order_by="period").drop("t", "period")
