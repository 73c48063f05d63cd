import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment

SCHEMA = "doc_id long, text string"
TEXTS = [None, "", " ", "a", "  two  spaces\n\n\ttab", "Hello, world's end 123 4.5", "naïve Größe 你好 🙂 x́y", "<|endoftext|> <s>x</s> <0x0A> ▁ ", "ﬁ ①½", "un dos　tres x", "word " * 700, "x" * 3000, "\x00\x01"]
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
PLAIN = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTED)}


@cache
def libraries():
    first, second = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    first.encode_special_tokens = True
    return first, second


def tokens(text):
    """(id, bytes) by both, from the libraries one text at a time."""
    first, second = libraries()
    a = [(i, bytes(PLAIN[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
    want = (" " + text).encode()
    return (a, b) if text and all(b"".join(x for _, x in side) == want for side in (a, b)) else ([], [])


def ranges(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    """Every pair of tokens compared, windows and anchors unknown."""
    found, counts = [], Counter()
    for i, text in rows:
        a, b = map(ranges, tokens(text or ""))
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 1000 else crossing(a, b)
        counts.update(links)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, s, e in side if start < e <= end) for side in (a, b)))
            start = end
        found.append((i, len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for i, n_a, n_b, groups, links in found
    ]


def crossing(a, b):
    out, j = [], 0
    for x, s, e in a:
        while j < len(b) and b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_matches_brute_force(spark, frequent):
    rows = [*enumerate(TEXTS), (3, "a"), (None, "again a"), (None, "again a")]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), frequent=frequent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text() | st.text("abé  \n\t▁<|>0x1.,'s"), min_size=1, max_size=6))
def test_windows_make_whole_documents(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tool = alignment.aligner(*alignment.default_paths())
    for (n_a, n_b, groups, n_links, text, pairs, times), want in zip(tool.align(texts), brute(list(enumerate(texts))), strict=True):
        assert (n_a, n_b, groups, n_links) == want[1:5] and times.sum() == n_links
        assert (hashlib.sha256(text.encode()).hexdigest() if n_a else "") == want[7]


def test_windows_are_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    tool = alignment.Aligner(*alignment.default_paths())
    texts = ["one two three four", "five two one", "", "seven eight one two"] * 2
    one, two = ([x[:5] for k in range(0, 8, n) for x in tool.align(texts[k : k + n])] for n in (1, 3))
    assert one == two == [x[:5] for x in alignment.Aligner(*alignment.default_paths()).align(texts)]


def test_the_rank_encoder_is_the_library():
    tool = alignment.ByteTokenizer(alignment.default_paths()[0])
    assert tool.ranks is not None
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in rng.integers(32, 0x2FFFF, 4000) if not 0xD800 <= c < 0xE000]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters, 9)) + " " + "".join(rng.choice(list("ab1 .\n'"), 20)) for _ in range(300)]
    fast, tool.ranks = tool.encode(texts), None
    assert fast == tool.encode(texts)


def test_empty_table_and_clashing_columns(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []
    got = alignment.align(spark.createDataFrame([(1, "a b", 2, "p")], SCHEMA + ", row int, pair string")).collect()
    assert [tuple(r) for r in got] == brute([(1, "a b")])
