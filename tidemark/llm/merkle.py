"""A Merkle manifest of a table: one tree for each group of rows, and one over their roots.

Nodes stand in tables by level, each with its tree, its place in the level and
the number of nodes there. A level meets itself once for each of the other
slots of a run (`sibling`), so every node knows its siblings; the nodes in
slot zero then emit the parents. A tree ends where one node is left; every run
is hashed, even a run of one.

Places come from a range sort and two sums over its partitions, so no group is
ever gathered in one task, however many of the rows it holds. Paths are handed
down from the roots: a node's path is its own siblings before its parent's
path, so each level moves a third (an ARITY-th) of the next one's bytes.

The hash H is the lowercase hex SHA-256 of its inputs end to end, digests as
hex text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

ARITY = 3
PATH = "array<struct<left:string,right:string>>"
TREE, PLACE, COUNT, HASH = "_tm_tree", "_tm_place", "_tm_count", "_tm_hash"


def leaf(*values: Column) -> Column:
    """H of values, each as its byte count, a colon and itself, or `-` where null; integers are decimal."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def sibling(place: Column, offset: int, arity: int) -> Column:
    """The place of the node that stands offset slots after place in its run, around its end."""
    if arity == 2:
        return place.bitwiseXOR(F.lit(1))
    slot = F.pmod(place, F.lit(arity))
    return place - slot + F.pmod(slot + offset, F.lit(arity))


def placed(leaves: DataFrame, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """leaves with the place of each in its tree, trees ascending and rows by order within them, and the tree's count.

    A range sort deals out the rows, whatever the size of a tree. The place is
    that in the row's partition, less where its tree begins there, plus the
    tree's rows in the partitions before.
    """
    by = [F.col(TREE).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    spread = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = scratch.save(spread.withColumns({"_tm_part": F.spark_partition_id(), "_tm_row": row}), name)
    parts = rows.groupBy("_tm_part", TREE).agg(F.min("_tm_row").alias("first"), F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy(TREE).orderBy("_tm_part")  # a row for each partition of a tree
    starts = parts.select(
        F.col("_tm_part").alias("part"),
        F.col(TREE).alias("tree"),
        (F.sum("n").over(so_far) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(TREE)).alias(COUNT),
    )
    held = rows.join(starts, (F.col("_tm_part") == F.col("part")) & F.col(TREE).eqNullSafe(F.col("tree")))
    return held.withColumn(PLACE, F.col("_tm_row") + F.col("shift")).drop("part", "tree", "shift", "_tm_part", "_tm_row")


def climb(leaves: DataFrame, scratch: Scratch, name: str, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every tree, nodes with the digests of their left and right siblings, and the roots (tree, hash, depth).

    leaves has TREE, PLACE, COUNT and HASH, and what else it has stays in level
    zero. Each level is a written table; lone leaves stand in level zero only.
    """
    most = leaves.agg(F.max(COUNT)).first()[0] or 0
    slot, root = F.pmod(F.col(PLACE), F.lit(arity)), F.col(COUNT) == 1
    levels, roots, nodes = [], leaves.filter(root).select(TREE, HASH, F.lit(0).alias("depth")), leaves
    while not levels or most > 1:
        joined = nodes
        for k in range(1, arity):
            other = nodes.select(F.col(TREE).alias("t"), F.col(PLACE).alias("p"), F.col(HASH).alias(f"h{k}"))
            joined = joined.join(other, F.col(TREE).eqNullSafe(F.col("t")) & (sibling(F.col(PLACE), k, arity) == F.col("p")), "left").drop("t", "p")
        # from slot s, the nodes 1, 2, ... slots on are those to the right up to the run's end, then those to the left
        digest = lambda k: F.coalesce(F.col(f"h{k}"), F.lit(""))
        right = F.concat(*(F.when(slot + k < arity, digest(k)).otherwise("") for k in range(1, arity)))
        left = F.concat(*(F.when(slot + k >= arity, digest(k)).otherwise("") for k in range(1, arity)))
        levels.append(scratch.save(joined.withColumns({"left": left, "right": right}).drop(*(f"h{k}" for k in range(1, arity))), f"{name}{len(levels)}"))
        first = levels[-1].filter((slot == 0) & ~root)
        parents = first.select(TREE, F.floor(F.col(PLACE) / arity).alias(PLACE), F.ceil(F.col(COUNT) / arity).alias(COUNT), F.sha2(F.concat(HASH, "right"), 256).alias(HASH))
        roots = roots.unionByName(parents.filter(root).select(TREE, HASH, F.lit(len(levels)).alias("depth")))
        nodes, most = parents.filter(~root), -(-most // arity)
    return levels, roots


def with_paths(levels: list[DataFrame], roots: DataFrame, carry: Sequence[str], arity: int = ARITY) -> DataFrame:
    """The rows of level zero with their paths and what the roots hand down.

    roots has TREE, depth, path and the columns of carry.
    """
    own, lone = F.array(F.struct("left", "right")), F.lit(-1).cast("long")  # a lone leaf's parent is the root's own row
    ended = lambda k: roots.filter(F.col("depth") == k).select(F.col(TREE).alias("t"), (F.lit(0).cast("long") if k else lone).alias("p"), "path", *carry)
    above = ended(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        met = levels[k].join(above, F.col(TREE).eqNullSafe(F.col("t")) & (F.floor(F.col(PLACE) / arity) == F.col("p")))
        above = met.select(F.col(TREE).alias("t"), F.col(PLACE).alias("p"), F.concat(own, "path").alias("path"), *carry).unionByName(ended(k))
    above, single = above.unionByName(ended(0)), F.col(COUNT) == 1
    met = levels[0].join(above, F.col(TREE).eqNullSafe(F.col("t")) & (F.when(single, lone).otherwise(F.floor(F.col(PLACE) / arity)) == F.col("p")))
    return met.withColumn("path", F.when(single, F.col("path")).otherwise(F.concat(own, "path"))).drop("t", "p", "left", "right")


def proofs(leaves: DataFrame, tree_col: str, order: Sequence[str], hash_col: str, arity: int = ARITY) -> DataFrame:
    """leaves with `subroot`, `root` and `path`, the siblings (left, right) of each level from the leaf's run up to root.

    Each value of tree_col (null is one) has a tree, its leaves ascending by
    order (null first); their roots, ordered by that value, are the leaves of
    the tree of `root`. Rows equal in order and hash may change places, which
    changes no digest. An empty table gives no rows. Other columns stay, unless
    their names are those of the results, or begin with `_tm_`.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    named = leaves.withColumns({TREE: F.col(f"`{tree_col}`"), HASH: F.col(f"`{hash_col}`"), "_tm_tie": F.monotonically_increasing_id()})
    held = placed(scratch.save(named, "rows"), [*order, HASH, "_tm_tie"], scratch, "leaves")
    levels, roots = climb(held, scratch, "level", arity)
    upper = scratch.save(roots.select(F.lit(0).alias(TREE), F.col(TREE).alias("member"), HASH, F.col("depth").alias("member_depth")), "roots")
    upper_levels, top = climb(placed(upper, ["member"], scratch, "upper"), scratch, "upper_level", arity)
    summit = top.select(TREE, "depth", F.array().cast(PATH).alias("path"), F.col(HASH).alias("root"))
    crowns = scratch.save(with_paths(upper_levels, summit, ["root"], arity), "crowns")
    crowns = crowns.select(F.col("member").alias(TREE), F.col("member_depth").alias("depth"), "path", F.col(HASH).alias("subroot"), "root")
    scratch.drop("rows", "leaves", "roots", "upper", *(f"upper_level{k}" for k in range(len(upper_levels))))
    return with_paths(levels, crowns, ["subroot", "root"], arity).drop(TREE, HASH, PLACE, COUNT, "_tm_tie")


def manifest(docs: DataFrame, tree_col: str = "source", order: Sequence[str] = ("doc_id",), columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), arity: int = ARITY) -> DataFrame:
    """(order columns, tree_col, leaf, path, subroot, root) of every row: what its digest is and how it is proved.

    Any column may be null; texts may be of any length, and equal rows are
    leaves of their own.
    """
    keys = list(dict.fromkeys([*order, tree_col]))
    rows = docs.select(*(F.col(f"`{c}`") for c in keys), leaf(*(F.col(f"`{c}`") for c in columns)).alias("leaf"))
    return proofs(rows, tree_col, order, "leaf", arity)


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, hash_, lambda h, step: F.sha2(F.concat(step.left, h, step.right), 256))


def proof_hash(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step.left, step.right)), ""), 256)
