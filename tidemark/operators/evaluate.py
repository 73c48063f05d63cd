"""Walk-forward evaluation: folds, losses, significance, blending and the leaderboard.

Predictions are rows (symbol, model, horizon, fold, pos, q10, q50, q90, p_up)
beside labels (symbol, horizon, pos, y); every symbol is evaluated in the same
plan, and a null symbol in none. Everything but the distribution functions is
joins, windows and aggregates within symbols; models meet their losses per
origin, never as matrices on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import binom_sf, t_cdf

QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
BASELINE = "naive"


@dataclass(frozen=True)
class Plan:
    min_train: int = 756
    step: int = 20
    embargo: int = 5
    max_folds: int = 30
    stride: int = 5
    refit_every: int = 3


def fold_table(sizes: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(symbol, fold, train_end, pos) of sizes (symbol, n): folds without an origin take no number, the last max_folds stay."""
    n, step = F.col("n").cast("long"), F.lit(plan.step).cast("long")
    rows = sizes.filter(n > plan.min_train).select("symbol", "n", F.explode(F.sequence(F.lit(plan.min_train).cast("long"), n - 1, step)).alias("start"))
    inside = F.filter(F.sequence(F.col("start"), F.least(F.col("start") + plan.step, n) - 1), lambda p: p % plan.stride == 0)
    rows = rows.select("symbol", (F.col("start") - 1 - plan.embargo).alias("train_end"), F.explode(inside).alias("pos"))
    own = Window.partitionBy("symbol")
    kept = rows.withColumn("back", F.dense_rank().over(own.orderBy(F.col("train_end").desc()))).filter(F.col("back") <= plan.max_folds)
    return kept.select("symbol", (F.max("back").over(own) - F.col("back")).cast("int").alias("fold"), "train_end", "pos")


def empirical(origins: DataFrame, returns: DataFrame, horizon: int, lookback: int = 756, least: int = 252) -> DataFrame:
    """naive and drift quantiles at each origin, from the trailing h-day sums.

    Positions are joined by buckets of lookback: an origin's frame lies in its
    own bucket and the one before, so each origin meets two buckets only.
    """
    sums = returns.withColumn("s", F.when(F.count("ret").over(_rows(horizon)) >= math.ceil(0.6 * horizon), F.sum("ret").over(_rows(horizon)))).filter("s is not null")
    sums = sums.select("symbol", F.col("pos").alias("at"), "s", F.floor(F.col("pos") / lookback).alias("bucket"))
    spread = origins.select("symbol", "fold", "pos", F.explode(F.array(*[F.floor(F.col("pos") / lookback) - k for k in (0, 1)])).alias("bucket"))
    frame = spread.join(sums, ["symbol", "bucket"]).filter((F.col("at") <= F.col("pos")) & (F.col("at") > F.col("pos") - lookback))
    q = frame.groupBy("symbol", "fold", "pos").agg(F.percentile("s", F.array(*map(F.lit, QUANTILES.values()))).alias("q"), F.avg((F.col("s") > 0).cast("double")).alias("up"), F.count("s").alias("n")).filter(F.col("n") >= least)
    row = lambda name, shift, p: F.struct(F.lit(name).alias("model"), *[(F.col("q")[k] - shift).alias(c) for k, c in enumerate(QUANTILES)], p.alias("p_up"))
    both = q.select("symbol", "fold", "pos", F.inline(F.array(row("naive", F.col("q")[1], F.lit(0.5)), row("drift", F.lit(0.0), F.col("up")))))
    return both.withColumn("horizon", F.lit(horizon))


def _rows(n: int):
    return Window.partitionBy("symbol").orderBy("pos").rowsBetween(1 - n, 0)


def labels(returns: DataFrame, horizon: int) -> DataFrame:
    """(symbol, horizon, pos, y): the sum of the next returns, null ones as zero, where enough are valid and all within the data."""
    own = Window.partitionBy("symbol")
    ahead = own.orderBy("pos").rowsBetween(1, horizon)
    least = 1 if horizon == 1 else math.ceil(horizon / 2)
    whole = F.col("pos") + horizon <= F.max("pos").over(own)
    y = F.when(whole & (F.count("ret").over(ahead) >= least), F.sum(F.coalesce("ret", F.lit(0.0))).over(ahead))
    return returns.select("symbol", F.lit(horizon).alias("horizon"), "pos", y.alias("y"))


def pinball(y: Column, pred: Column, q: float) -> Column:
    d = y - pred
    return F.greatest(q * d, (q - 1) * d)


def losses(preds: DataFrame, realized: DataFrame) -> DataFrame:
    scored = preds.join(realized, ["symbol", "horizon", "pos"]).filter("y is not null and q50 is not null")
    mean = sum((pinball(F.col("y"), F.col(c), q) for c, q in QUANTILES.items()), F.lit(0.0)) / len(QUANTILES)
    return scored.withColumn("loss", mean)


def block_test(diffs: DataFrame, keys: list[str], block: int) -> DataFrame:
    """diffs (keys, pos, d): t and p of the mean of whole blocks against zero; fewer than four blocks are made four."""
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = diffs.filter("d is not null").withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    size = F.when(F.floor(F.col("n") / block) >= 4, F.lit(block)).otherwise(F.floor(F.col("n") / 4))
    rows = rows.filter("n >= 4").withColumn("size", size).withColumn("blocks", F.when(F.floor(F.col("n") / block) >= 4, F.floor(F.col("n") / block)).otherwise(4))
    means = rows.withColumn("b", F.floor(F.col("i") / F.col("size"))).filter(F.col("b") < F.col("blocks")).groupBy(*keys, "blocks", "b").agg(F.avg("d").alias("m"))
    sd = F.stddev_samp("m")
    tested = means.groupBy(*keys, "blocks").agg(F.when(sd > 0, F.avg("m") / (sd / F.sqrt(F.count("m")))).alias("t"))
    return tested.withColumn("p", t_cdf(F.col("t"), (F.col("blocks") - 1).cast("double")))


def holm(rows: DataFrame, p: str = "p", tie: str = "model", keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with p_adj, step-down over the rows of a key that have a p; without keys all rows are one short list of tests."""
    own = Window.partitionBy(*keys)
    tests = rows.withColumn("_m", F.count(p).over(own))
    scaled = tests.withColumn("_r", F.row_number().over(own.orderBy(F.col(p).asc_nulls_last(), tie))).withColumn("_s", F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p)))
    running = F.max("_s").over(own.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("p_adj", F.when(F.col(p).isNotNull(), running)).drop("_m", "_r", "_s")


def inverse_loss_weights(mean_loss: DataFrame, keys: list[str]) -> DataFrame:
    """mean_loss (keys, model, loss) with weights in proportion to 1 / loss; equal ones where no loss is known."""
    per = Window.partitionBy(*keys)
    inverse = F.try_divide(F.lit(1.0), F.col("loss"))
    total = F.sum(inverse).over(per)
    return mean_loss.withColumn("weight", F.when(total > 0, F.coalesce(inverse, F.lit(0.0)) / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(per)))


def past_losses(scored: DataFrame, folds: DataFrame, horizon: int, window: int = 8, least: int = 3) -> DataFrame:
    """(symbol, fold, model, loss): the mean loss of the last usable folds, settled before each fold's training ends."""
    cut = folds.select("symbol", F.col("fold").alias("at"), "train_end").distinct()
    settled = scored.filter(F.col("horizon") == horizon).join(cut, "symbol").filter((F.col("pos") + horizon <= F.col("train_end")) & (F.col("fold") < F.col("at")))
    own = Window.partitionBy("symbol", "at")
    ranked = settled.withColumn("back", F.dense_rank().over(own.orderBy(F.col("fold").desc()))).filter(F.col("back") <= window)
    mean = ranked.withColumn("usable", F.max("back").over(own)).groupBy("symbol", "at", "model").agg(F.max("usable").alias("usable"), F.avg("loss").alias("loss"))
    names = scored.select("symbol", "model").distinct()
    out = cut.join(names, "symbol").join(mean, ["symbol", "at", "model"], "left")
    return out.select("symbol", F.col("at").alias("fold"), "model", F.when(F.col("usable") >= least, F.col("loss")).alias("loss"))


def blend(preds: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """One prediction an origin: means over the models that have a value, weights renormalised for each, quantiles sorted."""
    cells = preds.join(weights.select("symbol", "fold", "model", "weight"), ["symbol", "fold", "model"])
    mean = lambda c: F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))).alias(c)
    out = cells.groupBy("symbol", "horizon", "fold", "pos").agg(*[mean(c) for c in (*QUANTILES, "p_up")])
    ranked = F.array_sort(F.array(*QUANTILES))
    return out.select("symbol", F.lit(name).alias("model"), "horizon", "fold", "pos", *[ranked[k].alias(c) for k, c in enumerate(QUANTILES)], "p_up")


def best_only(mean_loss: DataFrame, keys: list[str]) -> DataFrame:
    """All weight on the least loss; the baseline where none is known; ties to the first name."""
    order = Window.partitionBy(*keys).orderBy(F.col("loss").asc_nulls_last(), (F.col("model") != BASELINE).cast("int"), "model")
    return mean_loss.withColumn("weight", (F.row_number().over(order) == 1).cast("double"))


def _spaced(by: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None  # the open group and what it kept last, carried over batches
        for batch in batches:
            kept = []
            for k, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                keys, pos = row[:-1], row[-1]
                if keys != group or pos > last and pos - last >= by:
                    group, last = keys, pos
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def spaced(rows: DataFrame, keys: list[str], by: int) -> DataFrame:
    """(keys, pos): the greedy subset of positions at least by apart; each ordered group streams through one task, which holds its last position only."""
    ordered = rows.filter("pos is not null").select(*keys, F.col("pos").cast("bigint").alias("pos")).repartition(*keys).sortWithinPartitions(*keys, "pos")
    return ordered.mapInArrow(_spaced(by), ordered.schema)


def leaderboard(scored: DataFrame, horizon: int, block: int, alpha: float = 0.05) -> DataFrame:
    """Every model of every symbol at a horizon against the baseline, on the origins both have."""
    own = scored.filter(F.col("horizon") == horizon)
    base = own.filter(F.col("model") == BASELINE).select("symbol", "pos", F.col("loss").alias("base_loss"), F.col("q50").alias("base_mid"))
    both = own.join(base, ["symbol", "pos"])
    apart = spaced(both.filter("y <> 0"), ["symbol", "model"], horizon).withColumn("alone", F.lit(True))
    both = both.join(apart, ["symbol", "model", "pos"], "left")
    hit = F.when(F.col("alone"), ((F.col("p_up") >= 0.5) == (F.col("y") > 0)).cast("double"))
    rows = both.groupBy("symbol", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count("alone").alias("n_independent"), F.avg(F.abs(F.col("y") - F.col("q50"))).alias("mae"),
        F.try_divide(F.avg(F.abs(F.col("y") - F.col("q50"))), F.avg(F.abs(F.col("y") - F.col("base_mid")))).alias("mase"), F.avg("loss").alias("pinball"),
        (1 - F.try_divide(F.avg("loss"), F.avg("base_loss"))).alias("skill"), F.avg(F.col("y").between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage"),
        F.avg(hit).alias("dir_acc"), F.sum(hit).alias("_hits"), F.avg(F.when(F.col("alone"), (F.col("y") > 0).cast("double"))).alias("_up"), F.avg(F.pow(F.col("p_up") - (F.col("y") > 0).cast("double"), 2)).alias("brier"),
    )
    null = F.least(F.greatest(F.col("_up"), 1 - F.col("_up")), F.lit(1 - 1e-9))
    rows = rows.withColumn("dir_p", binom_sf(F.col("_hits"), F.col("n_independent").cast("double"), null)).drop("_hits", "_up")
    tested = block_test(both.filter(F.col("model") != BASELINE).select("symbol", "model", "pos", (F.col("loss") - F.col("base_loss")).alias("d")), ["symbol", "model"], block)
    adjusted = holm(tested.select("symbol", "model", "p"), keys=("symbol",))
    out = rows.join(adjusted.withColumnRenamed("p", "dm_p").withColumnRenamed("p_adj", "dm_p_adj"), ["symbol", "model"], "left")
    return out.withColumn("horizon", F.lit(horizon)).withColumn("edge", F.coalesce((F.col("skill") > 0) & (F.col("dm_p_adj") < alpha), F.lit(False)))
