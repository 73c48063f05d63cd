"""Gradient-boosted trees on histograms, grown for many models at once.

A model is a value of the column `model` (say a symbol, a fold and a quantile);
all of them grow in the same jobs, a level of a tree at a time. Features are
binned once by global quantiles; a level's histograms are one aggregation by
(model, node, feature, bin), combined before the shuffle, so what is shuffled
follows models, nodes and bins and never rows. Splits are windows over
histograms. Trees are tables: nothing of a model passes through the driver.

Objectives: `quantile` (gradients of the pinball loss with unit weights, leaves
refilled with the quantile of their residuals) and `binary` (logistic loss).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.written import Written


@dataclass(frozen=True)
class Settings:
    """trees and depth of each model; rate by which a tree counts; ridge on leaf weights; fewest rows of a leaf; shares of rows and features that a tree sees."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.1
    ridge: float = 1.0
    least_rows: int = 20
    bins: int = 32
    subsample: float = 1.0
    colsample: float = 1.0


def edges(rows: DataFrame, features: Sequence[str], bins: int, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(by, edges array<array<double>>): for each feature the distinct values that end its bins but the last, from quantiles of all rows of a key."""
    shares, none = F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.array().cast("array<double>")
    cuts = [F.array_sort(F.array_distinct(F.percentile_approx(F.when(~F.isnan(f), F.col(f)), shares, F.lit(accuracy)))) for f in features]
    return rows.groupBy(*by).agg(F.array(*[F.coalesce(c, none) for c in cuts]).alias("edges"))


def binned(rows: DataFrame, cuts: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows with `bins`, the bin of each feature: 0 for null and NaN, else 1 and the number of edges below the value."""
    values = F.array(*[F.when(~F.isnan(f), F.col(f).cast("double")) for f in features])
    below = lambda v, e: F.when(v.isNull(), 0).otherwise(F.size(F.filter(e, lambda x: x < v)) + 1)
    met = rows.join(cuts, list(by)) if by else rows.crossJoin(F.broadcast(cuts))  # without a key, one row of edges
    return met.withColumn("bins", F.zip_with(values, F.col("edges"), below)).drop("edges")


def gradients(rows: DataFrame) -> DataFrame:
    """rows (y, pred, alpha; alpha null for binary) with the loss's first and second derivatives g and h."""
    p = 1 / (1 + F.exp(-F.col("pred")))
    quantile = F.when(F.col("y") < F.col("pred"), 1 - F.col("alpha")).otherwise(-F.col("alpha"))
    return rows.withColumns({"g": F.when(F.col("alpha").isNull(), p - F.col("y")).otherwise(quantile), "h": F.when(F.col("alpha").isNull(), p * (1 - p)).otherwise(1.0)})


def histograms(rows: DataFrame, used: Column | None = None) -> DataFrame:
    """(model, node, feature, bin, n, g, h) of rows (model, node, bins, g, h); used says which features of a model count."""
    cells = rows.select("model", "node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    if used is not None:
        cells = cells.filter(used)
    return cells.groupBy("model", "node", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(cells: DataFrame, ridge: float, least_rows: int, digits: int = 9) -> DataFrame:
    """(model, node, feature, bin, gain): the best split of each node that has one; rows of bins up to `bin` go left. Ties go to the first feature and bin."""
    own = Window.partitionBy("model", "node", "feature")
    so_far = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    left = {c: F.sum(c).over(so_far) for c in ("n", "g", "h")}
    whole = {c: F.sum(c).over(own) for c in ("n", "g", "h")}
    sides = cells.select("model", "node", "feature", "bin", *[x.alias(f"l{c}") for c, x in left.items()], *[x.alias(f"w{c}") for c, x in whole.items()])
    score = lambda g, h: g * g / (h + ridge)
    right = {c: F.col(f"w{c}") - F.col(f"l{c}") for c in ("n", "g", "h")}
    gain = score(F.col("lg"), F.col("lh")) + score(right["g"], right["h"]) - score(F.col("wg"), F.col("wh"))
    allowed = sides.filter((F.col("ln") >= least_rows) & (right["n"] >= least_rows)).withColumn("gain", F.round(gain, digits)).filter("gain > 0")
    best = F.max_by(F.struct("feature", "bin", "gain"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return allowed.groupBy("model", "node").agg(best.alias("s")).select("model", "node", "s.*")


def moved(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows one level down: to node 2 n or 2 n + 1; where a node has no split all go to 2 n."""
    s = splits.select("model", "node", F.col("feature").alias("_f"), F.col("bin").alias("_b"))
    right = F.coalesce(F.try_element_at("bins", F.col("_f") + 1) > F.col("_b"), F.lit(False))
    return rows.join(s, ["model", "node"], "left").withColumn("node", 2 * F.col("node") + right.cast("int")).drop("_f", "_b")


def at_alpha(values: Column, alphas: Sequence[float]) -> Column:
    """That one of the quantiles by alphas which a row's own alpha names."""
    return F.element_at(values, F.array_position(F.array(*map(F.lit, alphas)), F.col("alpha")).cast("int"))


def quantiles_of(x: Column, alphas: Sequence[float]) -> Column:
    return F.percentile_approx(x, F.array(*map(F.lit, alphas)), F.lit(10_000))


def leaf_values(rows: DataFrame, alphas: Sequence[float], ridge: float) -> DataFrame:
    """(model, node, value): the quantile of a leaf's residuals, or its Newton step."""
    step = -F.sum("g") / (F.sum("h") + ridge)
    out = rows.groupBy("model", "node", "alpha").agg(step.alias("step"), quantiles_of(F.col("y") - F.col("pred"), alphas).alias("q"))
    return out.select("model", "node", F.when(F.col("alpha").isNull(), F.col("step")).otherwise(at_alpha(F.col("q"), alphas)).alias("value"))


def base_scores(rows: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(model, base): the quantile of all labels, or the logarithm of the odds."""
    share = F.greatest(F.least(F.avg("y"), F.lit(1 - 1e-6)), F.lit(1e-6))
    out = rows.groupBy("model", "alpha").agg(F.log(share / (1 - share)).alias("odds"), quantiles_of(F.col("y"), alphas).alias("q"))
    return out.select("model", F.when(F.col("alpha").isNull(), F.col("odds")).otherwise(at_alpha(F.col("q"), alphas)).alias("base"))


def share_of(what: Column, share: float) -> Column:
    """A fixed choice of a share of all values."""
    return F.pmod(what, F.lit(1 << 20)) < share * (1 << 20)


def train(rows: DataFrame, alphas: Sequence[float] = (0.1, 0.5, 0.9), settings: Settings = Settings()) -> DataFrame:
    """(model, base, trees) of rows (model, alpha, bins, y); alpha is one of alphas, or null for a binary y.

    trees is an array of (tree, splits by node, leaves by node). Rows without a
    label are left out; a model without a labelled row is not there.
    """
    s, written = settings, Written(rows.sparkSession, "boost")
    known = rows.filter("y is not null").select("model", "alpha", "bins", F.col("y").cast("double").alias("y"))
    base = written.save(base_scores(known, alphas), "base")
    state = written.save(known.join(base, "model").withColumnRenamed("base", "pred"), "state-1")
    splits, leaves = [], []
    for tree in range(s.trees):
        own = gradients(state).withColumn("node", F.lit(1))
        seen = share_of(F.xxhash64("model", "bins", "y", F.lit(tree)), s.subsample) if s.subsample < 1 else F.lit(True)
        used = share_of(F.xxhash64("model", "feature", F.lit(tree)), s.colsample) if s.colsample < 1 else None
        for level in range(s.depth):
            found = written.save(best_splits(histograms(own.filter(seen), used), s.ridge, s.least_rows), f"splits{tree}-{level}")
            splits.append(found.withColumn("tree", F.lit(tree)))
            own = moved(own, found)
        filled = written.save(leaf_values(own, alphas, s.ridge), f"leaves{tree}")
        leaves.append(filled.withColumn("tree", F.lit(tree)))
        after = own.join(filled, ["model", "node"]).select("model", "alpha", "bins", "y", (F.col("pred") + s.rate * F.col("value")).alias("pred"))
        if tree < s.trees - 1:
            state = written.save(after, f"state{tree}")
            written.drop(f"state{tree - 1}")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    by_node = lambda value: F.map_from_entries(F.collect_list(F.struct("node", value)))
    of_tree = union(leaves).groupBy("model", "tree").agg(by_node(F.col("value")).alias("leaves"))
    cut = union(splits).groupBy("model", "tree").agg(by_node(F.struct("feature", "bin", "gain").alias("split")).alias("splits"))
    trees = of_tree.join(cut, ["model", "tree"], "left").groupBy("model").agg(F.array_sort(F.collect_list(F.struct("tree"))).alias("_order"), F.map_from_entries(F.collect_list(F.struct("tree", F.struct("splits", "leaves")))).alias("_t"))
    models = written.save(trees.join(base, "model").select("model", "base", F.transform("_order", lambda o: F.element_at(F.col("_t"), o.tree)).alias("trees")), "models")
    written.drop("base", *(f"state{k}" for k in range(-1, s.trees)), *(f"leaves{k}" for k in range(s.trees)), *(f"splits{k}-{d}" for k in range(s.trees) for d in range(s.depth)))
    return models


def predicted(models: DataFrame, rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """rows (model, bins, ...) with `score`: base and the leaves of all trees; the log odds of a binary model."""
    steps = F.sequence(F.lit(1), F.lit(settings.depth))

    def leaf(tree: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            split = F.try_element_at(tree.splits, node)
            return 2 * node + F.coalesce(F.try_element_at("bins", split.feature + 1) > split.bin, F.lit(False)).cast("int")

        return F.coalesce(F.try_element_at(tree.leaves, F.aggregate(steps, F.lit(1), down)), F.lit(0.0))

    total = F.aggregate("trees", F.lit(0.0), lambda out, tree: out + leaf(tree))
    return rows.join(models, "model").withColumn("score", F.col("base") + settings.rate * total).drop("base", "trees")


def importance(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """(model, feature, gain, splits) by what the splits on each feature gained."""
    every = models.select("model", F.explode("trees").alias("t")).filter("t.splits is not null").select("model", F.explode(F.map_values("t.splits")).alias("s"))
    name = F.element_at(F.array(*map(F.lit, features)), F.col("s.feature") + 1)
    return every.groupBy("model", name.alias("feature")).agg(F.sum("s.gain").alias("gain"), F.count(F.lit(1)).alias("splits"))


def forecasts(rows: DataFrame, folds: DataFrame, features: Sequence[str], horizon: int, quantiles: dict[str, float], refit_every: int = 3, least_train: int = 300, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Predictions (symbol, model 'boost', horizon, fold, pos, quantiles, p_up) at the origins of folds, and the models.

    rows are (symbol, pos, features, y). A model serves refit_every folds; it
    sees the rows whose labels end by the first one's train_end, and its bins
    are those of these rows. Frames with fewer than least_train labelled rows
    have none, and quantiles are sorted.
    """
    starts = folds.select("symbol", "fold", "train_end", "pos", F.floor(F.col("fold") / refit_every).alias("g")).withColumn("frame", F.concat_ws("/", "symbol", "g"))
    cut = starts.groupBy("symbol", "frame").agg(F.min("train_end").alias("cut"))
    train_rows = rows.filter("y is not null").join(cut, "symbol").filter(F.col("pos") + horizon <= F.col("cut")).select("frame", *features, "y")
    enough = train_rows.groupBy("frame").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_train).select("frame")
    written = Written(rows.sparkSession, "boosted")
    cuts = written.save(edges(train_rows, features, settings.bins, ["frame"]).join(enough, "frame"), "edges")
    targets = [*((c, q) for c, q in quantiles.items()), ("p_up", None)]
    model = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.lit(q).cast("double").alias("alpha")) for c, q in targets]))
    label = F.when(F.col("alpha").isNull(), (F.col("y") > 0).cast("double")).otherwise(F.col("y"))
    named = F.concat_ws("/", "frame", "target")
    known = binned(train_rows, cuts, features, ["frame"]).select("frame", "bins", "y", model.alias("m")).select("frame", "bins", "y", "m.*")
    models = train(known.select(named.alias("model"), "alpha", "bins", label.alias("y")), tuple(quantiles.values()), settings)
    asked = starts.join(rows.drop("y"), ["symbol", "pos"])
    asked = binned(asked, cuts, features, ["frame"]).select("symbol", "fold", "pos", "frame", "bins", F.explode(F.array(*[F.lit(c) for c, _ in targets])).alias("target"))
    scored = predicted(models, asked.withColumn("model", named), settings)
    pick = lambda c: F.max(F.when(F.col("target") == c, F.col("score")))
    wide = scored.groupBy("symbol", "fold", "pos").agg(F.array_sort(F.array(*[pick(c) for c in quantiles])).alias("q"), (1 / (1 + F.exp(-pick("p_up")))).alias("p_up"))
    out = wide.select("symbol", F.lit("boost").alias("model"), F.lit(horizon).alias("horizon"), "fold", "pos", *[F.col("q")[k].alias(c) for k, c in enumerate(quantiles)], "p_up")
    return out, models
