"""Connected components of an edge table by contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b): nodes have one root when a path joins them.

    Each round maps a node to the least of itself and its neighbours, in the
    order of a fixed hash, and contracts the edges; the hash order makes the
    expected number of rounds logarithmic also on chains, and a star takes two.
    The driver sees only whether edges are left. Without edges there are no rows.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    edges = scratch.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    roots, level = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0), 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), ranked("b").alias("best")).union(edges.select(F.col("b"), ranked("a")))
        parent = both.groupBy("node").agg(F.min("best").alias("best")).select("node", F.least("best", ranked("node")).getField("node").alias("up"))
        parent = scratch.save(parent, f"parent{level}")
        ups = lambda c: parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        met = edges.join(ups("a"), "a").join(ups("b"), "b").filter("a_up <> b_up")
        left = scratch.save(met.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), f"edges{level + 1}")
        if level:
            roots = roots.join(parent.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        else:
            roots = parent.select("node", F.col("up").alias("root"))
        roots = scratch.save(roots, f"roots{level}")
        scratch.drop(f"edges{level}", f"parent{level}", f"roots{level - 1}")
        edges, level = left, level + 1
    return roots
