"""Futures rolls: where contracts switch, and what that does to returns and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import backward_filled, forward_filled, ordered, previous

BEFORE, AFTER, JUMP, MASK_AFTER = 4, 1, 1.8, 1


def volume_jump() -> Column:
    return F.try_divide(F.col("volume"), F.nullif(previous("volume"), F.lit(0.0)))


def detect_rolls(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (symbol, expiry, start, end) with the session of the roll, the method and the masked rows.

    The session of the largest day-over-day volume ratio in the window, the
    first of equals; without a jump of JUMP the whole window is masked. A
    window past the last bar is provisional.
    """
    placed = bars.withColumn("pos", F.row_number().over(ordered())).withColumn("ratio", volume_jump())
    last = bars.groupBy("symbol").agg(F.max("date").alias("_last"))
    inside = windows.join(placed.filter("pos > 1").select("symbol", "date", "pos", "ratio"), "symbol").filter(F.col("date").between(F.col("start"), F.col("end")))
    best = F.max(F.when(F.col("ratio").isNotNull(), F.struct("ratio", (-F.col("pos")).alias("p"), "date")))
    found = inside.groupBy("symbol", "expiry", "start", "end").agg(best.alias("best"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    volume = F.coalesce(F.col("best.ratio") >= JUMP, F.lit(False))
    return found.join(last, "symbol").select(
        "symbol", "expiry", F.when(volume, F.col("best.date")).alias("roll_date"), F.when(volume, "volume").otherwise("window").alias("method"),
        F.when(volume, -F.col("best.p")).otherwise(F.col("first_pos")).alias("mask_from"), F.when(volume, -F.col("best.p") + MASK_AFTER).otherwise(F.col("last_pos")).alias("mask_to"),
        (F.col("end") > F.col("_last")).alias("provisional"),
    )


def masked_returns(bars: DataFrame, rolls: DataFrame) -> DataFrame:
    """bars with the reason a return is masked (missing, nonpositive_price, roll) and the log return elsewhere."""
    placed = bars.withColumn("pos", F.row_number().over(ordered()))
    rolled = rolls.select("symbol", F.explode(F.sequence("mask_from", "mask_to")).alias("pos")).distinct().withColumn("rolled", F.lit(True))
    out = placed.join(rolled, ["symbol", "pos"], "left").withColumn("before", previous("close"))
    reason = (
        F.when((F.col("close") <= 0) | (F.col("before") <= 0), "nonpositive_price")
        .when(F.col("close").isNull() | F.col("before").isNull(), "missing")
        .when(F.col("rolled"), "roll")
    )
    out = out.withColumn("reason", reason)
    return out.withColumn("ret", F.when(F.col("reason").isNull(), F.log(F.col("close") / F.nullif(F.col("before"), F.lit(0.0))))).drop("before", "rolled")


def adjusted(masked: DataFrame) -> DataFrame:
    """Levels anchored at the last positive close and carried back over the unmasked returns: for display, since it looks ahead."""
    anchor = masked.filter("close > 0").groupBy("symbol").agg(F.max("pos").alias("a"), F.max_by("close", "pos").alias("anchor"))
    out = masked.join(anchor, "symbol", "left")
    total = F.sum(F.coalesce("ret", F.lit(0.0)))
    after = F.coalesce(total.over(ordered().rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    out = out.withColumn("_after", after)
    at_anchor = F.max(F.when(F.col("pos") == F.col("a"), F.col("_after"))).over(Window.partitionBy("symbol"))
    out = out.withColumn("close_adj", F.col("anchor") * F.exp(-(F.col("_after") - at_anchor)))
    out = out.withColumn("_factor", F.when(F.col("close") > 0, F.try_divide(F.col("close_adj"), F.col("close"))))
    out = out.withColumn("factor", F.coalesce(forward_filled(F.col("_factor")), backward_filled(F.col("_factor"))))
    return out.drop("a", "anchor", "_after", "_factor")


def in_windows(rows: DataFrame, windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """rows with in_window: whether their date falls into any window of their symbol; known at the time."""
    hit = rows.select("symbol", "date").distinct().join(windows.select("symbol", start, end), "symbol").filter(F.col("date").between(F.col(start), F.col(end))).select("symbol", "date").distinct()
    return rows.join(hit.withColumn("in_window", F.lit(True)), ["symbol", "date"], "left").withColumn("in_window", F.coalesce("in_window", F.lit(False)))
