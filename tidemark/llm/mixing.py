"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule over it, a
line through knots, and a target of words. Integrating the schedule says how
much of its target a source owes by any time; inverting that demand at the
place where a document stands in its source's stream says when the document is
due. Documents are then range-sorted by that position.

The stream of a source is its documents in the order of a fixed hash. Where a
document stands in it is a sum in two levels: over buckets of that order from
a small table, and within a bucket by a window. A bucket holds about the
square root of all rows, so a source with a third of them is many buckets.
Everything is DataFrame expressions; text moves once for the window, and once
more for the sort where it is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Knots (time, factor) by which a source's weight is multiplied; each has the mean 1, so the weights hold over the whole run.
SHAPES = (((0.0, 4 / 3), (1.0, 2 / 3)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
LEAST_BUCKET = 1000


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def due(part: Column, shape: Column, shapes: Sequence = SHAPES) -> Column:
    """The time at which a source has been asked for this part (0 to 1) of its target."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(shapes):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        total, done = sum(areas), 0.0
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
            rest = part * F.lit(float(total)) - F.lit(float(done))
            slope = (w1 - w0) / (t1 - t0)
            at = F.lit(float(t0)) + F.coalesce(F.try_divide(F.lit(2.0) * rest, F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(float(w0 * w0)) + F.lit(2.0 * slope) * rest, F.lit(0.0)))), F.lit(0.0))
            out = F.when(out.isNull() & (shape == k) & (rest <= F.lit(float(area)) * (1 + 1e-12)) & (rest >= 0), at).otherwise(out)
            done += area
    return out


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """rank, weight and target of each source of (source, source_size): one row a source, which one task can hold.

    Sources in order of their code points, null last, take the weights in
    turn and share the given part of all words by weight; what a source would
    get above cap times its size goes to the others, by weight, until none is
    above.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level)  # of what is left once all sources before are at their caps; the highest one holds
    return ranked.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(everything))).drop("most", "level")


OWN = ("size", "source_size", "target", "taken", "position", "passes", "_tm_order")


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",), names: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, shapes: Sequence = SHAPES) -> DataFrame:
    """Each row of docs with what the mix takes of it.

    Added to the carried columns: size, source_size, target, taken (words,
    repeats counted), passes (array of position and words, one entry for each
    time the document is taken) and position (the first one; null where it is
    never taken). A source's taken words add up to its rounded target: passes
    over the source follow one another and the last document of the last pass
    is taken in part. Null texts and texts without words have size 0 and are
    taken where their place in the stream is. A null source is a source; null
    and repeated ids are rows like others. An empty table gives no rows. Carried
    columns get the given names; without names, those called like one of the
    operator's own give way to it.
    """
    names = names or [c for c in carry if c not in OWN]
    carry = carry if len(names) == len(carry) else names
    scratch = Scratch(docs.sparkSession, "mix")
    rows = max(1, docs.count())
    digits = max(1, math.ceil(math.log(rows / max(LEAST_BUCKET, math.sqrt(rows)), 16))) if rows > LEAST_BUCKET else 1
    source = F.col(f"`{source_col}`").cast("string")
    order = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("#"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).cast("binary"))  # null ids in the order of their texts
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(f"_tm_c{k}") for k, c in enumerate(carry)],
        F.col(f"`{id_col}`").alias("_tm_id"), words(F.col(f"`{text_col}`")).alias("size"), order.alias("_tm_order"), F.substring(order, 1, digits).alias("_tm_bucket"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_tm_key"),
    )
    sums = scratch.save(keyed.groupBy("_tm_key", "_tm_bucket").agg(F.sum("size").alias("words")), "sums")
    named = F.when(F.col("_tm_key") != "", F.substring("_tm_key", 2, 1 << 30)).alias("source")
    sources = targets(sums.groupBy("_tm_key").agg(F.sum("words").alias("source_size")).select("*", named), weights, share, cap)
    ahead = Window.partitionBy("_tm_key").orderBy("_tm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_tm_key", "_tm_bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("_tm_base"))
    base = scratch.save(base.join(sources.drop("source"), "_tm_key"), "base")

    tie = [F.xxhash64(f"_tm_c{k}") for k in range(len(carry))]  # rows of one id and size in the order of what they carry
    inner = Window.partitionBy("_tm_key", "_tm_bucket").orderBy("_tm_order", "_tm_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(base.hint("merge"), ["_tm_key", "_tm_bucket"]).withColumn("_tm_at", F.col("_tm_base") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    goal = F.floor(F.col("target") + 0.5)
    passes = []
    for k in range(cap):
        at = F.col("_tm_at") + F.lit(k) * F.col("source_size")
        take = F.least(F.greatest(goal - at, F.lit(0)), F.col("size"))
        position = due(at.cast("double") / F.greatest("target", F.lit(1.0)), F.col("rank") % len(shapes), shapes)
        passes.append(F.when(at < goal, F.struct(position.alias("position"), take.cast("long").alias("words"), F.lit(k).alias("pass"))))
    placed = placed.withColumn("passes", F.array_compact(F.array(*passes)))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.select(
        *[F.col(f"_tm_c{k}").alias(c) for k, c in enumerate(names)], "size", "source_size", "target", taken.alias("taken"),
        F.try_element_at("passes", F.lit(1))["position"].alias("position"), "passes", "_tm_order",
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; rows that share one, or have none, are spread by the stream's hash."""
    by = [F.col("position").asc_nulls_last(), F.col("_tm_order")]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tm_order")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them, in training order, with the columns of docs.

    A document is there once for each pass that takes it. Documents are whole
    here: the one at a pass's end is in when at least half of it is due.
    """
    held = [f"_tm_d{k}" for k in range(len(docs.columns))]
    mixed = mix(docs, docs.columns, held, **options).select(*held, F.col("size").alias("_tm_size"), F.explode("passes").alias("_tm_pass"), "_tm_order")
    mixed = mixed.filter("2 * _tm_pass.words >= _tm_size").withColumn("position", F.col("_tm_pass.position"))
    ordered = in_order(mixed)
    return ordered.select(*[F.col(h).alias(c) for h, c in zip(held, docs.columns, strict=True)])
