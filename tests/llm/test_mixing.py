import hashlib
import re
from collections import defaultdict

import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(n=400):
    rows = [(i, "w " * (i * 7 % 53), f"s{min(i % 11, 4)}") for i in range(n)]
    return rows + [(n, None, "s1"), (n + 1, "", None), (n + 2, "a\x0bb\tc d", None), (None, "null id", "s2"), (7, "w " * 49, "s4"), (n + 3, "x " * 900, "z")]


def brute(rows, share=1.5, cap=2.0):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    target, left, open_ = {}, share * sum(total.values()), set(sources)
    while open_:
        got = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if got[s] >= cap * total[s]}
        for s in over or open_:
            target[s] = cap * total[s] if over else got[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    out = []
    for s in sources:
        at = 0
        order = lambda k: (hashlib.md5(str(rows[k][0] if rows[k][0] is not None else "").encode()).hexdigest(), -1 if rows[k][0] is None else rows[k][0], size[k])
        for k in sorted((k for k in range(len(rows)) if rows[k][2] == s), key=order):
            goal = int(target[s] + 0.5)
            take = sum(min(max(goal - at - p * total[s], 0), size[k]) for p in range(2))
            out.append((rows[k][0], size[k], total[s], target[s], take))
            at += size[k]
    return out


def test_matches_brute_force(spark):
    rows = corpus()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    for a, b in zip(sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a == pytest.approx(b)
    assert all(sum(p.words for p in r.passes) == r.taken <= 2 * r.size and all(0 <= p.position <= 1 for p in r.passes) for r in got)


def test_demand_is_inverted(spark):
    shapes = (((0.0, 0.0), (0.25, 2.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)))
    parts = [k / 40 for k in range(40)]
    rows = spark.createDataFrame([(p, s) for p in parts for s in (0, 1)], "part double, shape int")
    for r in rows.select("part", "shape", mixing.due(mixing.F.col("part"), mixing.F.col("shape"), shapes).alias("t")).collect():
        steps = [k / 20_000 * r.t for k in range(20_001)]
        knots = shapes[r["shape"]]
        weight = lambda t, knots=knots: next(w0 + (w1 - w0) * (t - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False) if t <= t1)
        area = sum((weight(a) + weight(b)) / 2 * (b - a) for a, b in zip(steps, steps[1:], strict=False))
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
        assert area / whole == pytest.approx(r.part, abs=1e-6)


def test_repeated_rows_in_training_order(spark):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(corpus())], SCHEMA + ", rank int")
    got = mixing.repeated(docs).collect()
    assert got[0].asDict().keys() == set(docs.columns)
    words, sizes = defaultdict(int), defaultdict(int)
    for r in got:
        words[r.source] += len((r.text or "").split())
    for r in brute(corpus()):
        sizes[r[2]] = r[3]
    assert abs(words["s4"] - max(sizes.values())) < 60


def test_empty_table(spark):
    assert mixing.in_order(mixing.mix(spark.createDataFrame([], SCHEMA))).collect() == []
