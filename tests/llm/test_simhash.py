import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.scratch import Scratch

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    best = {i: min(j for j, g in rows if (f ^ g).bit_count() <= 3) for i, f in rows}
    changed = True
    while changed:
        changed = False
        for i, f in rows:
            low = min(best[j] for j, g in rows if (f ^ g).bit_count() <= 3)
            if low < best[i]:
                best[i], changed = low, True
    return best


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randrange(30, 400))) for _ in range(40)]
    for base in texts[:8]:
        for _ in range(6):
            words = base.split()
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    return texts + texts[:5] + [None, "", "  \t\n", "one", "One", "two words", "É è ü", "x " * 30_000, texts[0].upper()]


def test_matches_brute_force(spark):
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in enumerate(texts)]
    want = brute_components(prints)
    assert got == {i: (f, want[i]) for i, f in prints}


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_links_connect_what_distance_connects(spark, bucket):
    rng = np.random.default_rng(5)
    centre = rng.integers(-(2**62), 2**62, 6)
    points = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centre for _ in range(30)}
    rows = [(i, p) for i, p in enumerate(sorted(points))]
    scratch = Scratch(spark, "test")
    edges = simhash.links(spark.createDataFrame([(p,) for _, p in rows], "fp long"), scratch, bucket=bucket).collect()
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 3 for e in edges)
    at = {p: i for i, p in rows}
    best = dict(enumerate(range(len(rows))))
    for _ in rows:
        for e in edges:
            best[at[e.a]] = best[at[e.b]] = min(best[at[e.a]], best[at[e.b]])
    assert best == brute_components([(i, p & (1 << 64) - 1) for i, p in rows])


def test_empty_and_clashing_columns(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = spark.createDataFrame([(5, "a b c d", 1, "x"), (5, "a b c d", 2, "y"), (None, "a b c d", 3, "z")], SCHEMA + ", fp int, k string")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(extra).collect()) == [(-1, 5), (5, 5), (5, 5)]
