"""Queries of the forecast models: boosted trees and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import boost, evaluate, features, forecast

from .catalog import register
from .series import RETURNS, all_series, c, day_returns, over, rolled

SELDOM = evaluate.Plan(refit_every=10)  # each model serves ten folds
NAMES = ("cum_5", "vol_20", "dd_252")
BINS = 16
SEEN = f"""{RETURNS}, level AS (SELECT *, exp(sum(coalesce(ret, 0)) {over()}) AS level FROM returns),
wide AS (
  SELECT symbol, pos, {rolled("sum", 5, 3)} AS cum_5, {rolled("stddev_samp", 20, 12)} AS vol_20, level / {rolled("max", 252, 60, "level")} - 1 AS dd_252,
         lead(ret) OVER (PARTITION BY symbol ORDER BY pos) AS y
  FROM level),
seen AS (SELECT symbol, pos, round(cum_5, 6) AS cum_5, round(vol_20, 6) AS vol_20, round(dd_252, 6) AS dd_252, round(y, 6) AS y FROM wide)"""
CELLS = "long AS (" + " UNION ALL ".join(f"SELECT symbol, pos, y, {k} AS feature, {name} AS x FROM seen" for k, name in enumerate(NAMES)) + ")"
CUTS = f"""cuts AS (
  SELECT symbol, feature, unnest(list_sort(list_distinct(quantile_disc(x, [{", ".join(f"{k / BINS}" for k in range(1, BINS))}])))) AS cut FROM long WHERE x IS NOT NULL GROUP BY 1, 2)"""


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each bar and the next return, rounded so that both engines bin the same numbers."""
    rows = features.price_features(day_returns(spark, sf_dir))
    y = F.lead("ret").over(features.ordered())
    return rows.select("symbol", "pos", *[F.round(x, 6).alias(x) for x in NAMES], F.round(y, 6).alias("y"))


@register("boost_edges", f"WITH {SEEN}, {CELLS}, {CUTS} SELECT symbol, CAST(feature AS INT) AS feature, CAST(row_number() OVER (PARTITION BY symbol, feature ORDER BY cut) AS INT) AS bin, cut FROM cuts")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = boost.edges(seen(spark, sf_dir), NAMES, BINS, ["symbol"])
    return cuts.select("symbol", F.posexplode("edges").alias("feature", "e")).select("symbol", "feature", F.posexplode("e").alias("k", "cut")).select("symbol", "feature", (c("k") + 1).alias("bin"), "cut")


@register("boost_first_split", f"""WITH {SEEN}, {CELLS}, {CUTS}, base AS (SELECT symbol, quantile_disc(y, 0.9) AS pred FROM seen GROUP BY 1),
binned AS (
  SELECT l.symbol, l.pos, l.feature, CASE WHEN l.x IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM cuts k WHERE k.symbol = l.symbol AND k.feature = l.feature AND k.cut < l.x) END AS bin,
         CASE WHEN l.y < b.pred THEN 0.1::DOUBLE ELSE -0.9::DOUBLE END AS g
  FROM long l JOIN base b USING (symbol) WHERE l.y IS NOT NULL),
hist AS (SELECT symbol, feature, bin, count(*) AS n, sum(g) AS g FROM binned GROUP BY 1, 2, 3),
sides AS (
  SELECT symbol, feature, bin, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(n) OVER v AS wn, sum(g) OVER v AS wg FROM hist
  WINDOW w AS (PARTITION BY symbol, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY symbol, feature)),
gains AS (
  SELECT *, round(lg * lg / (ln + 1) + (wg - lg) * (wg - lg) / (wn - ln + 1) - wg * wg / (wn + 1), 7) AS gain
  FROM sides WHERE ln >= 20 AND wn - ln >= 20)
SELECT symbol, CAST(arg_max(feature, [gain, -feature, -bin]) AS INT) AS feature, CAST(arg_max(bin, [gain, -feature, -bin]) AS INT) AS bin, round(max(gain), 5) AS gain FROM gains WHERE gain > 0 GROUP BY symbol""")
def first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the first tree for the 0.9 quantile of the next return, a model for each symbol."""
    rows = seen(spark, sf_dir)
    known = boost.binned(rows, boost.edges(rows, NAMES, BINS, ["symbol"]), NAMES, ["symbol"]).filter("y is not null").select(c("symbol").alias("model"), F.lit(0.9).alias("alpha"), "bins", "y", F.lit(1).alias("node"))
    state = known.join(boost.base_scores(known, (0.9,)), "model").withColumnRenamed("base", "pred")
    found = boost.best_splits(boost.histograms(boost.gradients(state)), 1.0, 20, digits=7)
    return found.select(c("model").alias("symbol"), "feature", "bin", F.round("gain", 5).alias("gain"))


@register("boost_leaderboard")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees beside the other models, every symbol at a horizon of five."""
    rows = features.price_features(day_returns(spark, sf_dir)).withColumn("pos", c("pos") - 1)
    names = ("r1", "cum_5", "cum_20", "cum_60", "vol_5", "vol_20", "vol_ratio_5_60", "dist_sma20", "dist_sma50", "dd_252")
    return forecast.walk_forward(all_series(spark, sf_dir), 5, SELDOM, features=forecast.Features(rows, names, boost.Settings(trees=6, depth=2, rate=0.4)))


@register("statespace_leaderboard")
def statespace_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched ARIMA and ETS beside autoregression and simple smoothing, every symbol at a horizon of five."""
    return forecast.walk_forward(all_series(spark, sf_dir), 5, SELDOM, search=True)
