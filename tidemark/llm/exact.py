"""Exact deduplication by most-significant-digit radix partitioning.

The radix string of a document is its length followed by its bytes. The first
digit is the length with the leading bytes; each later digit is a run of
bytes, eight times as wide as the one before, so a text of n bytes needs about
log8(n) rounds. A group leaves when it has one member or when its texts have
ended, which the shared length tells. No digest takes part in any decision.

Only documents whose first digit is shared carry their text further. Counts
are combined before they are shuffled, so a group that holds a third of all
rows costs one row a task; the join that hands the group's number back reads
both sides from written tables and is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

HEAD_BYTES = 32
GROWTH = 8


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Every row of docs with keep_id, group_size and kept.

    Texts are equal when all their bytes are; a null text counts as empty. The
    row with the largest id of each group stays (null ids come last; of rows
    that repeat the largest id exactly one stays). Other columns of docs are
    carried through; the text only on request. An empty table gives no rows.
    A column of docs that has the name of one of the operator's own (keep_id,
    group_size, kept, or any that starts with _tm_) gives way to it.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    carried = [c for c in docs.columns if c != text_col and c not in ("keep_id", "group_size", "kept") and not c.startswith("_tm_")]
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    digit = [F.octet_length(raw).alias("_tm_len"), F.substring(raw, 1, HEAD_BYTES).alias("_tm_head")]

    shared = docs.select(*digit).groupBy("_tm_len", "_tm_head").count().filter("count > 1")
    shared = scratch.save(shared.select("_tm_len", "_tm_head", F.monotonically_increasing_id().alias("_tm_gid")), "heads")
    text = F.col(f"`{text_col}`")
    split = docs.select(*[F.col(f"`{c}`") for c in carried], text.alias("_tm_text"), *digit).join(shared.hint("merge"), ["_tm_len", "_tm_head"], "left")
    split = split.select(
        *[F.col(f"`{c}`") for c in carried],
        (F.col("_tm_text") if with_text else F.when(F.col("_tm_gid").isNotNull(), F.col("_tm_text"))).alias("_tm_text"),
        "_tm_len", "_tm_gid", F.monotonically_increasing_id().alias("_tm_rid"),
    )
    split = scratch.save(split, "split")

    rest = F.expr(f"substring(cast(coalesce(_tm_text, '') as binary), {HEAD_BYTES + 1})")
    live = split.filter("_tm_gid is not null").select("_tm_rid", F.col(f"`{id_col}`").alias("_tm_id"), "_tm_gid", "_tm_len", rest.alias("_tm_rest"))
    decided, offset, width, level = [], HEAD_BYTES, HEAD_BYTES * GROWTH, 0
    while True:
        keyed = live.withColumn("_tm_digit", F.substring("_tm_rest", 1, width))
        groups = keyed.groupBy("_tm_gid", "_tm_digit").agg(F.count(F.lit(1)).alias("_tm_n"), F.max(F.struct("_tm_id", "_tm_rid")).alias("_tm_keep"))
        groups = scratch.save(groups.withColumn("_tm_next", F.monotonically_increasing_id()), f"groups{level}")
        done = (F.col("_tm_n") == 1) | (F.col("_tm_len") <= offset + width)
        step = keyed.join(groups.hint("merge"), ["_tm_gid", "_tm_digit"]).select(
            "_tm_rid", "_tm_id", F.col("_tm_next").alias("_tm_gid"), "_tm_len", done.alias("_tm_done"), "_tm_n", "_tm_keep",
            F.when(~done, F.expr(f"substring(_tm_rest, {width + 1})")).alias("_tm_rest"),
        )
        step = scratch.save(step, f"level{level}")
        scratch.drop(f"groups{level}")
        decided.append(step.filter("_tm_done").select("_tm_rid", "_tm_n", "_tm_keep"))
        live = step.filter("not _tm_done").select("_tm_rid", "_tm_id", "_tm_gid", "_tm_len", "_tm_rest")
        if live.isEmpty():
            break
        offset, width, level = offset + width, width * GROWTH, level + 1

    verdicts = decided[0]
    for more in decided[1:]:
        verdicts = verdicts.union(more)
    columns = [F.col(f"`{c}`") for c in carried] + [F.col("_tm_text").alias(text_col)] * with_text
    alone = split.filter("_tm_gid is null").select(*columns, F.col(f"`{id_col}`").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    grouped = split.filter("_tm_gid is not null").join(verdicts, "_tm_rid").select(*columns, F.col("_tm_keep._tm_id").alias("keep_id"), F.col("_tm_n").alias("group_size"), (F.col("_tm_rid") == F.col("_tm_keep._tm_rid")).alias("kept"))
    return alone.union(grouped)
