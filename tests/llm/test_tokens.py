import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, tokenfile, tokens

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, " \t\n", "Hello, World's end", "a" * 3000, "word " * 9000, "é ́x  wide space", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "\x1c\x1d\u0085 x", "straße ÀÉ ñ 123 4.5"]


@cache
def library():
    return Tokenizer.from_file(tokens.default_vocabulary())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text() | st.text("aAbtTéÉßİıſñŉǅΣς.,!'#<|>0 ́"), max_size=8))
def test_ids_are_the_library_s(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + [t or "" for t in TEXTS]
    got = list(tokens.encode(pa.array(texts), tokens.default_vocabulary(), 7))
    assert [x.tolist() for x in got] == [[*library().encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    got = list(tokens.encode(pa.array(["ab cd " * 60, "x" * 200, None]), tokens.default_vocabulary(), 7))
    assert [x.tolist() for x in got] == [[*library().encode(t, add_special_tokens=False).ids, 7] for t in ("ab cd " * 60, "x" * 200, "")]


def test_every_letter_of_the_shortcut_is_the_library_s():
    words = [w for c in tokens.LETTERS for w in (c, f"a{c}b", f"{c}{c}.,", f"T{c}é!")]
    ids, starts = tokens.WordEncoder(tokens.default_vocabulary()).by_words(pa.array(words, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [library().encode(w, add_special_tokens=False).ids for w in words]


def test_words_are_known_two_batches_later():
    words, calls = tokens.WordEncoder(tokens.default_vocabulary()), []

    class Counted:
        def tokenize(self, word, model=words.model):
            calls.append(word)
            return model.tokenize(word)

    words.model = Counted()
    letters = [chr(97 + k) for k in range(26)]
    one, two = (pa.array([" ".join(a + b + c + d for b in letters for c in letters for d in letters) for a in part], pa.large_string()) for part in (letters[:5], letters[5:10]))
    first, _ = words.texts(one), words.texts(two)
    before = len(calls)
    again = words.texts(one)
    assert len(calls) == before > 170_000  # words: about those of two batches of real size
    assert all((a == b).all() for a, b in zip(first, again, strict=True))


@pytest.mark.parametrize("pieces, size", [(0, 1 << 20), (6, 1 << 20), (1000, 50)])
def test_forgetting_changes_no_id(monkeypatch, pieces, size):
    monkeypatch.setattr(tokens, "CACHED_PIECES", pieces)
    monkeypatch.setattr(tokens, "CACHED_BYTES", size)
    words = tokens.WordEncoder(tokens.default_vocabulary())
    for texts in (TEXTS, TEXTS[::-1], ["one two, three!", "Two three four.", "x" * 100, ""], TEXTS):
        texts = [t or "" for t in texts]
        ids, starts = words.texts(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [library().encode(t, add_special_tokens=False).ids for t in texts]
        words.forget()
        assert len(words.pieces) <= pieces // 2 and len(words.used) == len(words.pieces) == len(words.starts) - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=400), st.integers(0, 5))
def test_blocks_round_trip(values, few):
    ids = np.resize(np.array(values if few else values[:1], np.uint32), -(-len(values) // 128) * 128)
    data, sizes = tokenfile.encode_blocks(ids)
    assert sizes.sum() == len(data)
    assert (tokenfile.decode_blocks(data, np.cumsum(sizes) - sizes) == ids).all()


def expected(end):
    return {i: np.array([*library().encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in enumerate(TEXTS * 3)}


def test_token_files_round_trip(spark):
    rows = list(enumerate(TEXTS * 3))[::-1]
    got = sorted(tuple(r) for r in tokenfile.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want, at = [], 0
    for i, ids in expected(1).items():
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_with_null_and_repeated_ids(spark):
    assert tokenfile.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    got = tokenfile.round_trip(spark.createDataFrame([(2, "b", 1), (None, "a", 2), (2, "b", 3)], SCHEMA + ", n_tokens int")).collect()
    assert sorted((r.start, r.doc_id) for r in got) == [(0, None), (2, 2), (4, 2)]


def test_reader_starts_at_any_id(tmp_path):
    ids = np.random.default_rng(1).integers(0, 49_408, 1000).astype("<u4")
    out = tokenfile.Writer(f"file://{tmp_path}/x.tok")
    out.add(1, ids)
    out.close()
    file = tokenfile.Reader(f"file://{tmp_path}/x.tok")
    for a, b in ((0, 1000), (127, 129), (500, 501), (999, 1000), (3, 3)):
        assert np.concatenate([*file.tokens(a, b), np.empty(0, "<u4")]).tolist() == ids[a:b].tolist()


@pytest.mark.parametrize("shard", [300, 1 << 22])
def test_every_id_is_packed_once(spark, shard):
    rows = packing.pack(spark.createDataFrame(list(enumerate(TEXTS * 3)), SCHEMA).coalesce(1), shard_tokens=shard).collect()
    ids, sequences = expected(2), {}
    for i, x in ids.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        assert [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces)])[:-1].tolist()
        assert sum(p[1] for p in pieces) == len(x) == pieces[0][3]
        assert all(zlib.crc32(x[s : s + n].tobytes()) == c for s, n, c, _ in pieces)
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    for pieces in sequences.values():
        pieces.sort()
        assert [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces)])[:-1].tolist()
        used = sum(p[1] for p in pieces)
        assert used == pieces[0][2] and (used == 4096 or used & used - 1 == 0 and used < 4096)


def test_packing_balances_cost():
    lengths = np.random.default_rng(2).integers(1, 2000, 800).tolist()
    load = {}
    for _, _, n, at, _, size in packing.assign(lengths):
        if size == 4096:
            load[at] = load.get(at, 0) + packing.cost(n)
    assert max(load.values()) < 1.6 * min(load.values())


def test_packing_of_an_empty_table_and_clashing_columns(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    got = packing.pack(spark.createDataFrame([(1, "a", 2), (1, "a", 3), (None, "b", 4)], SCHEMA + ", offset int")).collect()
    assert sorted(r.doc_id or 0 for r in got if r.start == 0) == [0, 1, 1]
