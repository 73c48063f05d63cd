"""Near copies by similarity: against brute force over shingle sets."""

import random

import numpy as np

from tidemark.llm import similar
from tidemark.llm.scratch import Scratch

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def brute_least(rows, similarity=0.8):
    """The least id that links of at least this similarity reach, by id."""
    sets, group = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randrange(80, 300))) for _ in range(60)]
    for base in texts[:12]:  # one word changed is six shingles of 75 or more: well above 0.8
        for _ in range(5):
            words = base.split()
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    for base in texts[12:24]:  # every fourth word changed: no shingle stays
        texts.append(" ".join(word() if k % 4 == 0 else w for k, w in enumerate(base.split())))
    return list(enumerate([*texts, "", "", None, "one", "ONE", "one two three", "one two four"]))


def test_components_equal_brute_force(spark):
    rows = corpus()
    out = similar.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_least(rows) and len(out) == len(rows)


def test_dealt_groups_lose_no_link(spark):
    rows = corpus()
    out = similar.near_duplicates(spark.createDataFrame(rows, SCHEMA), bucket=3).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_least(rows)


def test_sets_decide_what_bits_leave_open(spark):
    """Pairs about the bound: whatever is linked has the similarity, unless its bits say so beyond doubt."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, want = [], {}
    for k in range(120):
        base = [word() for _ in range(200)]
        other = base[:]
        for at in range(5, 195, 190 // (4 + k % 6)):
            other[at] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        want[2 * k] = len(a & b) / len(a | b)
    out = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = {i: out[i + 1] == i for i in want}
    assert sum(linked[i] for i, s in want.items() if s >= 0.8) >= 0.9 * sum(s >= 0.8 for s in want.values())
    sure, _ = similar.bounds(0.8)
    text = dict(rows)
    for i, s in want.items():
        bits = similar.apart(similar.fingerprint(text[i].encode())[None], similar.fingerprint(text[i + 1].encode())[None])[0]
        assert not linked[i] or s >= 0.8 or bits <= sure
    assert {s >= 0.8 for s in want.values()} == {True, False}


def test_forest_connects_what_each_bound_connects():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, (6, similar.LONGS))
    points = np.concatenate([base ^ (np.int64(1) << rng.integers(0, 60, (6, 1))) * (rng.random((6, similar.LONGS)) < 0.6) for _ in range(8)])
    tree = similar.forest(points, 40)
    for bound in range(41):
        group = np.arange(len(points))
        kept = group.copy()
        for i in range(len(points)):
            for j in np.flatnonzero(similar.apart(points, points[i]) <= bound):
                group[group == group[j]] = group[i]
        for i, j, _ in tree[tree[:, 2] <= bound]:
            kept[kept == kept[j]] = kept[i]
        assert all(len(set(kept[group == g])) == 1 for g in set(group)) and len(set(kept)) == len(set(group))


def test_groups_across_batches_and_sizes():
    rng = np.random.default_rng(5)
    points = rng.integers(-(2**63), 2**63 - 1, (90, similar.LONGS))
    points[50:60] = points[50] ^ (np.int64(1) << np.arange(10)[:, None])
    rows = np.column_stack([np.r_[np.zeros(45), np.ones(45)], np.zeros((90, 2)), np.arange(90)]).astype(np.int64)
    found = similar.group_links(np.column_stack([rows, points]), 46)
    assert {int(x) for r in found for x in r[:2]} == set(range(50, 60)) and len(found) == 9


def test_blocks_are_disjoint_within_a_splitting_and_widen():
    few, many = similar.blocks(1000, 0.8), similar.blocks(10**10, 0.8)
    assert few.shape[1] == 16 and many.shape[1] == 30 and len(many) > len(few)
    assert len(np.unique(few[:16])) == 256


def test_nulls_repeats_and_no_rows(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(None, t), (None, t), (3, t + " more"), (3, "other words"), (7, None), (8, "")]
    out = similar.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out) == [("3", 3), ("3", 3), ("7", 7), ("8", 7), ("None", 3), ("None", 3)]
    assert similar.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert Scratch(spark, "similar").root
