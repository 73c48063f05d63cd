import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

TEXTS = [
    "", None, "a@b", "x.y+z@mail.example.com, q@w.e", "a@b.c@d.e @x.y a@@b.c", "1.2.3.4 256.1.1.1 001.02.3.4.5 1.2.3", "4111 1111 1111 1111 and 4111111111111112",
    "call +1 (017) 555-7713 or +12 or +1.2.3.4.5.6.7.8", "é +49 30 1234567é", 'the token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" here',
]


def brute(text):
    out = [("email", m.start(), m.end()) for m in pii.EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        checked = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1]))
        if 16 <= len(digits) <= 19 and checked % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in pii.PHONE.finditer(text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("0123456789.@+- ()ab%_", max_size=60) | st.sampled_from([t or "" for t in TEXTS]))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    s = len(pii.STATES)
    x, lengths = rng.normal(size=(6, 4, s)), np.array([4, 3, 2, 1, 4, 4])
    step = np.where(pii.LINKED, rng.normal(size=(s, s)), pii.FLOOR)
    found = pii.viterbi(x, lengths, step)
    for k, n in enumerate(lengths):
        paths = np.stack(np.meshgrid(*[range(s)] * n, indexing="ij"), -1).reshape(-1, n)
        value = x[k, np.arange(n), paths].sum(axis=1) + step[paths[:, :-1], paths[:, 1:]].sum(axis=1) + np.where(pii.FIRST[paths[:, 0]], 0, pii.FLOOR)
        assert found[k].tolist() == paths[value.argmax()].tolist() + [-1] * (4 - n)


def test_gradient_is_that_of_the_likelihood():
    model = pii.Model(pii.examples(rows=4), rounds=1)
    words, states = pii.examples(rows=3)[1]
    words, states = words[-5:], ["O"] * 5
    ids, target = np.array([model.ids(w) for w in words]), np.array([pii.STATES.index(s) for s in states])
    paths = np.stack(np.meshgrid(*[range(len(pii.STATES))] * 5, indexing="ij"), -1).reshape(-1, 5)
    paths = paths[pii.FIRST[paths[:, 0]] & pii.LINKED[paths[:, :-1], paths[:, 1:]].all(axis=1)]

    def likelihood():
        x = model.scores(ids)
        value = lambda p: x[np.arange(5), p].sum(axis=-1) + model.step[p[..., :-1], p[..., 1:]].sum(axis=-1)
        return value(target) - np.log(np.exp(value(paths)).sum())

    grads = [np.zeros_like(p) for p in (model.own, model.near, model.step)]
    model.gradient(ids, target, grads, 1)
    for params, grad, at in ((model.own, grads[0], (ids[2, 0], 1)), (model.near, grads[1], (0, ids[1, 0], 3)), (model.step, grads[2], (0, 0))):
        before = likelihood()
        params[at] += 1e-5
        assert (likelihood() - before) / 1e-5 == pytest.approx(grad[at], abs=1e-3)
        params[at] -= 1e-5


def test_held_out_sentences():
    right = wrong = missed = 0
    rows = pii.examples(seed=99, rows=90)
    texts, want = [], []
    for words, states in rows:
        at, spans = 0, []
        for w, s in zip(words, states, strict=True):
            if s[0] == "B":
                spans.append([s[2:], at, at + len(w)])
            elif s[0] == "I":
                spans[-1][2] = at + len(w)
            at += len(w) + 1
        texts.append(" ".join(words))
        want.append({(k, a // 1) for k, a, _ in spans})
    for text, spans, got in zip(texts, want, pii.added_spans(texts, pii.trained()), strict=True):
        starts = {(k, a - (text[a - 1] in "\"'" if a else 0)) for k, a, _ in got}
        right, wrong, missed = right + len(starts & spans), wrong + len(starts - spans), missed + len(spans - starts)
    assert right > 0.9 * (right + missed) and right > 0.9 * (right + wrong)


def test_rows(spark):
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")).collect()}
    for i, t in enumerate(TEXTS):
        base = brute(t or "")
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]
        assert rows[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) - {""} <= set(rows[i].spans.split(","))
    assert rows[len(TEXTS) - 1].spans == "secret:13:53"
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
