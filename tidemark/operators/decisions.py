"""Decisions from scores: forecast signals, weighted views, verdicts, settled skill and budgets, a row for each symbol and horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import t_cdf

from . import backtest, evaluate, pit, regimes

#: The sign of an analyst's stance.
STANCES = {"bullish": 1.0, "neutral": 0.0, "bearish": -1.0}


def forecast_signal(horizons: DataFrame) -> DataFrame:
    """(symbol, signal, has_edge, note) of horizons (symbol, horizon, p_up, edge): the mean of 2 p - 1 over those with an edge, else 0."""
    edged = F.when(F.col("edge") & F.col("p_up").isNotNull(), 2 * F.col("p_up") - 1)
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(edged.isNotNull(), F.col("horizon")))), lambda h: F.concat(h.cast("string"), F.lit("d"))), ", ")
    out = horizons.groupBy("symbol").agg(F.avg(edged).alias("_s"), names.alias("_n"))
    clipped = F.greatest(F.least(F.coalesce("_s", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    note = F.when(F.col("_s").isNull(), "no measurable edge vs random walk: contributes 0").otherwise(F.concat(F.lit("edge at "), "_n"))
    return out.select("symbol", clipped.alias("signal"), F.col("_s").isNotNull().alias("has_edge"), note.alias("note"))


def components(views: DataFrame, forecasts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(symbol, name, weight, signal, contribution, note) for each configured weight and symbol of either table.

    views are (symbol, agent, stance, confidence), forecasts those of
    forecast_signal(); who is silent contributes 0 and keeps its weight.
    """
    sign = F.create_map(*[F.lit(x) for pair in STANCES.items() for x in pair])
    said = views.select("symbol", F.col("agent").alias("name"), (F.element_at(sign, F.col("stance")) * F.col("confidence")).alias("signal"), F.format_string("%s, confidence %.2f", "stance", "confidence").alias("note"))
    said = said.unionByName(forecasts.select("symbol", F.lit("forecast").alias("name"), "signal", "note"))
    symbols = views.select("symbol").union(forecasts.select("symbol")).distinct()
    grid = symbols.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in weights.items()])).alias("_w")).select("symbol", "_w.*")
    silent = F.when(F.col("name") == "forecast", "forecast unavailable").otherwise("agent disabled or failed: contributes 0")
    out = grid.join(said, ["symbol", "name"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    return out.select("symbol", "name", "weight", "signal", (F.col("weight") * F.col("signal")).alias("contribution"), F.coalesce("note", silent).alias("note"))


def decide(views: DataFrame, forecasts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(symbol, rating, score, conviction, components, forecast_edge)."""
    parts = components(views, forecasts, weights)
    total = F.sum("weight")
    out = parts.groupBy("symbol").agg((F.sum("contribution") / F.when(total != 0, total).otherwise(1.0)).alias("score"), F.array_sort(F.collect_list(F.struct("name", "weight", "signal", "contribution", "note"))).alias("components"))
    out = out.join(forecasts.select("symbol", F.col("has_edge").alias("forecast_edge")), "symbol", "left")
    return out.select("symbol", regimes.rating(F.col("score")).alias("rating"), "score", F.abs("score").alias("conviction"), "components", F.coalesce("forecast_edge", F.lit(False)).alias("forecast_edge"))


def chosen(board: DataFrame, baseline: str = evaluate.BASELINE, switch: str = "auto_select") -> DataFrame:
    """(symbol, horizon, model, edge, verdict) of a leaderboard: the best model with an edge, else the baseline and what came nearest."""
    keys = ["symbol", "horizon"]
    rivals = board.filter(~F.col("model").isin(baseline, switch))
    row = F.struct("skill", "model", "dm_p", "dm_p_adj", "edge")
    best = rivals.groupBy(*keys).agg(F.max_by(row, "skill").alias("best"), F.max_by(row, F.when(F.col("edge"), F.col("skill"))).alias("winner"), F.count(F.lit(1)).alias("n"))
    auto = board.filter(F.col("model") == switch).groupBy(*keys).agg(F.first(F.struct("skill", "dm_p_adj")).alias("auto"))
    out = board.select(*keys).distinct().join(best, keys, "left").join(auto, keys, "left")
    percent = lambda x: F.when(x.isNotNull(), F.format_string("%+.1f%%", x * 100)).otherwise("n/a")
    p = lambda x: F.when(x.isNotNull(), F.format_string("%.3g", x)).otherwise("n/a")
    horizon, won = F.concat(F.col("horizon").cast("string"), F.lit("d")), F.coalesce(F.col("winner.edge"), F.lit(False))
    edge = F.concat(F.col("winner.model"), F.lit(" beats the random walk at "), horizon, F.lit(": skill "), percent(F.col("winner.skill")), F.lit(", adjusted p "), p(F.col("winner.dm_p_adj")), F.lit("; best of "), F.col("n").cast("string"), F.lit(" models"))
    later = F.coalesce(F.concat(F.lit("; chosen on earlier folds only, "), percent(F.col("auto.skill"))), F.lit(""))
    none = F.concat(F.lit("no measurable edge at "), horizon, F.lit(": best "), F.col("best.model"), F.lit(", skill "), percent(F.col("best.skill")), F.lit(", adjusted p "), p(F.col("best.dm_p_adj")))
    verdict = F.when(won, F.concat(edge, later)).when(F.col("best.model").isNotNull(), none).otherwise(F.concat(F.lit("no model could be evaluated at "), horizon))
    return out.select(*keys, F.when(won, F.col("winner.model")).otherwise(F.lit(baseline)).alias("model"), won.alias("edge"), verdict.alias("verdict"))


def past_skill(scored: DataFrame, decisions: DataFrame, model: str, horizon: int, block: int, embargo: int = 5, least: int = 20, baseline: str = evaluate.BASELINE) -> DataFrame:
    """(symbol, at, scored, skill, p) of a model at each decision (symbol, at), on forecasts whose labels were final by then.

    A label that ends at pos + horizon counts once embargo more rows are there.
    What is settled at a decision is a prefix of the symbol's forecasts, so
    losses and whole blocks are running sums that an as-of join looks up. Only
    a prefix of fewer than four blocks, whose blocks are shorter, is gathered:
    that is less than 4 x block rows a decision.
    """
    own = scored.filter(F.col("horizon") == horizon)
    base = own.filter(F.col("model") == baseline).select("symbol", "pos", F.col("loss").alias("base_loss"))
    pairs = own.filter(F.col("model") == model).join(base, ["symbol", "pos"]).select("symbol", F.col("pos").cast("long").alias("pos"), "loss", "base_loss", (F.col("loss") - F.col("base_loss")).alias("d"))
    order = Window.partitionBy("symbol").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = pairs.withColumns({"i": F.row_number().over(order) - 1, "sum_loss": F.sum("loss").over(so_far), "sum_base": F.sum("base_loss").over(so_far), "tested": F.count("d").over(so_far)})
    # whole blocks of the differences there are, and what has been summed over those up to each
    known = rows.filter("d is not null").withColumn("b", F.floor((F.col("tested") - 1) / block))
    ends = known.groupBy("symbol", "b").agg(F.max("pos").alias("pos"), F.avg("d").alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == block)
    upto = Window.partitionBy("symbol").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("symbol", "pos", F.count("m").over(upto).alias("blocks"), F.avg("m").over(upto).alias("mean"), F.stddev_samp("m").over(upto).alias("sd"))
    asked = decisions.select("symbol", "at", (F.col("at") - horizon - embargo).cast("long").alias("cut")).distinct()
    met = pit.as_of_join(asked, rows, "cut", "pos", ["i", "sum_loss", "sum_base", "tested"], by=("symbol",))
    met = met.withColumn("scored", F.col("i") + 1).filter(F.col("scored") >= least)
    met = pit.as_of_join(met, ends, "cut", "pos", ["blocks", "mean", "sd"], by=("symbol",))
    few = met.filter(F.col("tested") < 4 * block).select("symbol", "at", "cut")
    early = known.filter(F.col("tested") <= 4 * block).select("symbol", "pos", "d")  # fewer than 4 x block rows a symbol
    short = evaluate.block_test(few.join(early, "symbol").filter("pos <= cut").select("symbol", "at", "pos", "d"), ["symbol", "at"], block)
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("blocks")))
    out = met.join(short.select("symbol", "at", F.col("p").alias("p_short")), ["symbol", "at"], "left")
    whole = t_cdf(t, (F.col("blocks") - 1).cast("double"))
    mean_loss, mean_base = F.col("sum_loss") / F.col("scored"), F.col("sum_base") / F.col("scored")
    skill = F.when(mean_base > 0, 1 - mean_loss / mean_base)
    return out.withColumn("p_long", whole).select("symbol", "at", F.col("scored").cast("long").alias("scored"), skill.alias("skill"), F.when(F.col("tested") >= 4 * block, F.col("p_long")).otherwise(F.col("p_short")).alias("p"))


def settled_signal(p_up: Column, skill: Column, p: Column, alpha: float = 0.05) -> Column:
    """2 p_up - 1 where a settled history shows a significant edge, else 0."""
    return F.when((skill > 0) & (p < alpha) & p_up.isNotNull(), 2 * p_up - 1).otherwise(0.0)


def decision_positions(origins: DataFrame, every: int, most: int) -> DataFrame:
    """(symbol, pos): origins at least every rows apart, the last ones there are."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("pos").desc()))
    return evaluate.spaced(origins.select("symbol", "pos"), ["symbol"], every).withColumn("_back", back).filter(F.col("_back") <= most).drop("_back")


def rebased(bars: DataFrame, starts: DataFrame) -> DataFrame:
    """bars with close in units of 100 at the last positive close up to each symbol's start (symbol, start).

    It fails where there is none: a raw price must not pass for an anonymous one.
    """
    base = bars.join(starts, "symbol").filter((F.col("date") <= F.col("start")) & (F.col("close") > 0)).groupBy("symbol").agg(F.max_by("close", "date").alias("_base"))
    factor = F.when(F.col("_base").isNull(), F.raise_error(F.lit("no positive close up to the first decision")).cast("double")).otherwise(100.0 / F.col("_base"))
    return bars.join(base, "symbol", "left").withColumn("close", F.col("close") * factor).drop("_base")


def remembered(models: DataFrame, dates: DataFrame) -> DataFrame:
    """(model, cutoff, before, n): how many decision dates fall up to each model's training cutoff; all may where it is unknown."""
    counted = models.select("model", "training_cutoff").groupBy("model").agg(F.min("training_cutoff").alias("cutoff")).join(dates.select("date"))
    return counted.groupBy("model", "cutoff").agg(F.count_if(F.coalesce(F.col("date") <= F.col("cutoff"), F.lit(True))).alias("before"), F.count(F.lit(1)).alias("n"))


def edge_pvalue(strategy: DataFrame, benchmark: DataFrame, block: int) -> DataFrame:
    """(symbol, p): one-sided, that the strategy's mean daily return beats the benchmark's; null where they never differ."""
    other = benchmark.select("symbol", "date", F.col("ret").alias("_b"))
    days = strategy.join(other, ["symbol", "date"]).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))).filter("pos > 1")
    diffs = days.select("symbol", "pos", (F.col("_b") - F.col("ret")).alias("d"))
    differ = diffs.groupBy("symbol").agg(F.bool_or(F.abs("d") > 1e-15).alias("differ"))
    return differ.join(evaluate.block_test(diffs, ["symbol"], block).select("symbol", "p"), "symbol", "left").select("symbol", F.when(F.col("differ"), F.col("p")).alias("p"))


def compare(rows: DataFrame, cost: float = 0.001, slippage: float = 0.0, per_roll: float = 0.0, block: int = 20) -> DataFrame:
    """(symbol, strategy, benchmark, excess, p) of rows (open, close, target, roll) from the first target on, against buying and holding."""
    window = backtest.first_valid(rows)
    strategy, held = backtest.run(window, cost, slippage, per_roll), backtest.run(backtest.buy_and_hold(window), cost, slippage, per_roll)
    packed = lambda m, name: m.select("symbol", F.struct(*[c for c in m.columns if c != "symbol"]).alias(name))
    own, bench = backtest.metrics(strategy), backtest.metrics(held)
    out = packed(own, "strategy").join(packed(bench, "benchmark"), "symbol").join(packed(backtest.excess(own, bench, ("cagr", "sharpe", "max_drawdown")), "excess"), "symbol")
    return out.join(edge_pvalue(strategy, held, block), "symbol", "left")


def charged(calls: DataFrame, most_usd: float, most_tokens: int) -> DataFrame:
    """calls (run, seq, cost_usd, tokens, est_usd, est_tokens) with what their run had spent before and whether the call was within its budget.

    A call is let through when what is spent and its own estimate stay within both limits.
    """
    before = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    out = calls.withColumn("spent_usd", spent("cost_usd").cast("double")).withColumn("spent_tokens", spent("tokens").cast("long"))
    return out.withColumn("allowed", (F.col("spent_usd") + F.col("est_usd") <= most_usd) & (F.col("spent_tokens") + F.col("est_tokens") <= most_tokens))


def until(rows: DataFrame, cut: Column, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """rows (symbol, pos, ..., y_h) as seen at position cut: later rows go, and labels that end after it are null."""
    seen = rows.filter(F.col("pos") <= cut)
    return seen.withColumns({f"y_{h}": F.when(F.col("pos") + h <= cut, F.col(f"y_{h}")) for h in horizons if f"y_{h}" in rows.columns})
