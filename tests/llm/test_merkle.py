import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = SCHEMA.replace(",", "").split()[::2]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(leaves, arity):
    """All levels of one tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, place, arity):
    out = []
    for level in levels[:-1]:
        run = place - place % arity
        out.append(("".join(level[run:place]), "".join(level[place + 1 : run + arity])))
        place //= arity
    return out


def brute(rows, arity):
    low = lambda x: (x is not None, x if isinstance(x, int) else (x or "").encode())
    sources = sorted({r[1] for r in rows}, key=low)
    members = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (low(r[0]), leaf(r))) for s in sources}
    trees = {s: grow([leaf(r) for r in members[s]], arity) for s in sources}
    upper = grow([trees[s][-1][0] for s in sources], arity)
    return sorted(
        (str(r[0]), leaf(r), trees[s][-1][0], upper[-1][0], path(trees[s], k, arity) + path(upper, at, arity)) for at, s in enumerate(sources) for k, r in enumerate(members[s])
    )


def table(seed, sizes):
    rng = random.Random(seed)
    rows = [(rng.choice([None, rng.randrange(-50, 500)]), s, rng.choice([None, "de"]), rng.choice([None, 3]), rng.choice([None, "", "é\na", f"t{k}\n" * 3])) for s, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("arity", "sizes"), [(3, {None: 4, "a": 1, "b": 40, "é": 3, "": 2, "z": 9, "B": 10}), (2, {"a": 17, "b": 1, "c": 2}), (4, {"a": 65}), (3, {"a": 1}), (3, {"a": 1, "b": 1})])
def test_matches_brute_force(spark, arity, sizes):
    rows = table(arity, sizes)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), arity=arity)
    found = got.withColumns({"again": merkle.folded(F.col("leaf"), F.col("path")), "proof": merkle.proof_hash(F.col("path"))}).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in found) == brute(rows, arity)
    assert all(r.again == r.root and r.proof == digest(*(x for s in r.path for x in s)) for r in found)


def test_a_changed_leaf_is_found(spark):
    rows = table(5, {"a": 30, "b": 8})
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).withColumn("folded", merkle.folded(F.sha2("leaf", 256), F.col("path")))
    assert got.filter("folded = root").count() == 0


def test_equal_rows_and_clashing_columns(spark):
    rows = [(7, "a", "de", 1, "same", k) for k in range(11)] + [(8, "a", "de", 1, "other", 0)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA + ", path int")).collect()
    want = brute([r[:5] for r in rows], 3)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got) == want


def test_empty_table_and_a_long_text(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    row = (1, "a", None, 4, "word \n" * 400_000)
    r = merkle.manifest(spark.createDataFrame([row], SCHEMA)).first()
    assert (r.leaf, r.subroot, r.path) == (leaf(row), leaf(row), []) and r.root == r.leaf


def test_one_tree_is_dealt_out(spark):
    rows = spark.range(20_000).select("id", F.lit("a").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    from tidemark.llm.scratch import Scratch

    held = merkle.placed(rows.withColumns({merkle.TREE: F.col("source"), merkle.HASH: F.col("h")}), ["id"], Scratch(spark, "test"), "x")
    assert held.filter(F.col(merkle.PLACE) != F.col("id")).count() == 0
    assert held.select(F.countDistinct("_tm_count"), F.max("_tm_count")).first()[:] == (1, 20_000)
