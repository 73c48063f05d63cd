import random

import numpy as np

from tidemark.llm import pii

ACCOUNT = "iban DE44 1234 5678 9012 3456"


def whole(text, model):
    """Spans of a text that is decoded as one sequence."""
    words = list(pii._WORD.finditer(text))
    ids = np.array([model.ids(m[0]) for m in words])
    states = [pii.STATES[s] for s in pii.viterbi(model.scores(ids)[None], np.array([len(words)]), np.where(pii.LINKED, model.step, pii.FLOOR))[0]]
    out = []
    for m, s in zip(words, states, strict=True):
        if s[0] == "B":
            out.append([s[2:], m.start(), m.end()])
        elif s[0] == "I":
            out[-1][2] = m.end()
    parts = [(k, a + len(text[a:b]) - len(text[a:b].lstrip(pii._EDGE)), text[a:b].strip(pii._EDGE)) for k, a, b in out]
    return [(k, a, a + len(t)) for k, a, t in parts if pii._DIGIT.search(t)]


def test_an_account_anywhere_in_a_long_text():
    texts = [f"{'wort ' * before}{ACCOUNT}{' wort' * 300}" for before in range(100, 140)]
    for text, spans in zip(texts, pii.added_spans(texts, pii.trained()), strict=True):
        at = text.index("DE44")
        assert spans == [("account", at, at + len(ACCOUNT) - 5)]


def test_cues_beside_an_edge():
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [f"{'wort ' * before}{cue} {body}{' wort' * 100}" for before in range(120, 132) for cue, body in (("token =", key), ("ssn", "123-45-6789"))]
    spans = pii.added_spans(texts, pii.trained())
    assert [[(k, t[a:b]) for k, a, b in s] for t, s in zip(texts, spans, strict=True)] == [[("secret", key)], [("national_id", "123-45-6789")]] * 12


def test_long_texts_match_decoding_as_one_sequence():
    rng, rows = random.Random(3), pii.examples(seed=77, rows=120)
    texts = [" ".join(w for _ in range(15) for w in [*rng.choice(rows)[0], *["wort"] * rng.randrange(30)]) for _ in range(30)]
    texts += ["12 " * 3000, "", "no digit", " 7"]
    assert pii.added_spans(texts, pii.trained()) == [whole(t, pii.trained()) if t.strip() else [] for t in texts]
