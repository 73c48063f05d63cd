"""Alignment of two tokenisations of the same text, by windows between verified anchors.

Both tokenisers encode the whole text. An anchor is a byte offset where a token
of each ends and a space-marked token of each begins; anchors cut the document
into windows, about a word each. What a window's tokens make of one another
(groups between shared ends, and links between tokens whose bytes overlap) is
worked out once for each tuple of ids and remembered.

Counts of linked id pairs are those of the whole corpus. They are added up
within tasks first, then by a shuffle. The FREQUENT most frequent pairs, a
bounded table, are broadcast back to the documents; the pairs beyond them go by
a join, in which no key can be hot, as every frequent one is already answered.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .scratch import Scratch
from .tokens import STAND_INS

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
FREQUENT = 1 << 20  # pairs that are broadcast: 16 bytes each
REMEMBERED = 150_000  # windows a worker remembers
HELD_PAIRS = 1 << 19  # distinct pairs whose counts a task holds before it passes them on
ROWS = 256  # documents encoded at once
SCORED_ROWS = 512  # documents whose pairs are looked up at once
SECOND = np.uint32(1 << 31)  # marks an id of the second tokeniser within a window's key


def default_paths() -> tuple[str, str]:
    """The byte-level and the piece vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteTokenizer:
    """A byte-level BPE of the tokenizers library; its ids are those of space + text, special strings being plain text.

    Where the file is a plain byte-level BPE whose ids are its ranks, a rank
    encoder gives the same ids several times as fast; any other file is
    encoded by the library itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        plain = {chr(c): b for b, c in STAND_INS.items()}
        decoded = {i: bytes(plain[c] for c in t) if all(c in plain for c in t) else t.encode() for t, i in vocabulary.items()}
        self.bytes = [decoded.get(i, b"") for i in range(max(decoded) + 1)]
        self.ranks = self._ranks(path, vocabulary)

    def _ranks(self, path: str, vocabulary: dict[str, int]):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, split = made["model"], made["pre_tokenizer"] or {}
        by_bytes = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        ranked = all(vocabulary.get("".join(m)) == 256 + k for k, m in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
        odd = made["normalizer"] or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
        if not by_bytes or not ranked or odd:
            return None
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes)}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [f" {t}" for t in texts]
        if self.ranks is not None:
            return [self.ranks.encode_ordinary(t) for t in spaced]
        return [e.ids for e in self.library.encode_batch_fast(spaced, add_special_tokens=False)]


class PieceTokenizer:
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.vocab_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if self.model.is_byte(i) else None
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Windows:
    """The alignments of windows, by the ids of their tokens: number, text of the groups, and links."""

    def __init__(self, first: list[bytes], second: list[bytes]) -> None:
        self.sizes = [np.array([len(b) for b in side], np.int64) for side in (first, second)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups, self.n_links = np.empty(0, np.int64), np.empty(0, np.int64)
        self.at, self.links = np.zeros(1, np.int64), np.empty(0, np.int64)

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """The number of each window; those not met before are aligned together."""
        if len(self.texts) > REMEMBERED:
            self.clear()
        known = self.known
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            self.add(new)
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def add(self, keys: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(keys), "<u4")
        window = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys])
        second = ids >= SECOND
        sides = []
        for side, own in enumerate((~second, second)):
            x = (ids[own] & ~SECOND).astype(np.int64)
            sides.append((x, window[own], np.cumsum(self.sizes[side][x])))
        (a, of_a, ends_a), (b, _, ends_b) = sides
        # both sides cover the same bytes, window by window, so ends compare across all of them
        links_a, links_b = segments(ends_a, ends_b)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n_links, groups = (np.bincount(of_a[x], minlength=len(keys)) for x in (links_a, np.searchsorted(ends_a, shared)))
        self.groups, self.n_links = np.r_[self.groups, groups], np.r_[self.n_links, n_links]
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(n_links)]
        self.links = np.r_[self.links, a[links_a] << 32 | b[links_b]]
        self.texts += written(a, ends_a, b, ends_b, shared, np.cumsum(groups))
        self.known |= {k: len(self.known) + i for i, k in enumerate(keys)}


def segments(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions (in a, in b) of every two tokens whose bytes overlap; each two overlap in one stretch, which ends where either ends."""
    cuts = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


def written(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, shared: np.ndarray, stops: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each window; stops: how many groups there are up to a window's end."""
    to_a, to_b = np.searchsorted(ends_a, shared, "right").tolist(), np.searchsorted(ends_b, shared, "right").tolist()
    a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups, i, j = [], 0, 0
    for p, q in zip(to_a, to_b, strict=True):
        groups.append(f"{a[i] if p == i + 1 else ','.join(a[i:p])}|{b[j] if q == j + 1 else ','.join(b[j:q])}")
        i, j = p, q
    out, i = [], 0
    for k in stops.tolist():
        out.append(";".join(groups[i:k]))
        i = k
    return out


class Aligner:
    def __init__(self, first: str, second: str) -> None:
        self.tokenizers = ByteTokenizer(first), PieceTokenizer(second)
        self.first, self.second = (t.bytes for t in self.tokenizers)
        self.sizes = [np.array(list(map(len, t.bytes)), np.int64) for t in self.tokenizers]
        self.marked = [np.array([b.startswith(b" ") for b in t.bytes]) for t in self.tokenizers]
        self.windows = Windows(self.first, self.second)

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids by both; none of a text whose bytes either does not keep."""
        out = []
        for text, a, b in zip(texts, self.tokenizers[0].encode(texts), self.tokenizers[1].encode(texts), strict=True):
            want = f" {text}".encode()
            kept = text != "" and all(b"".join(map(side.__getitem__, ids)) == want for side, ids in ((self.first, a), (self.second, b)))
            out.append((a, b) if kept else ([], []))
        return out

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(tokens by the first, by the second, groups, links, text of the groups, distinct links, how often) of each text."""
        both = self.encoded(texts)
        n = [np.array([len(x[side]) for x in both], np.int64) for side in (0, 1)]
        a, b = (np.concatenate([np.array(x[side], np.int64) for x in both]) for side in (0, 1))
        at_a, at_b, keys = self.cut(a, b, np.cumsum(n[0]))
        numbers = self.windows.numbers(keys)
        of_doc = np.searchsorted(at_a, np.r_[0, np.cumsum(n[0])])  # windows up to each document's end
        w = self.windows
        for k in range(len(texts)):
            own = numbers[of_doc[k] : of_doc[k + 1]]
            links = w.n_links[own]
            ends = np.cumsum(links)
            total = int(ends[-1]) if len(ends) else 0
            found = w.links[np.arange(total) + np.repeat(w.at[own] - ends + links, links)]
            text = ";".join(map(w.texts.__getitem__, own.tolist()))
            yield int(n[0][k]), int(n[1][k]), int(w.groups[own].sum()), total, text, *np.unique(found, return_counts=True)

    def cut(self, a: np.ndarray, b: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Where each window begins in a and in b (with the ends), and its key, for documents end to end."""
        if not len(a):
            return np.zeros(1, np.int64), np.zeros(1, np.int64), []
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        begins = np.r_[self.marked[0][a][1:], True]
        begins[doc_ends[doc_ends > 0] - 1] = True  # a document's end is an anchor of its own
        candidates = np.flatnonzero(begins)
        at = np.searchsorted(ends_b, ends_a[candidates])
        verified = ends_b[np.minimum(at, len(b) - 1)] == ends_a[candidates]
        spaced = np.r_[self.marked[1][b][1:], True][np.minimum(at, len(b) - 1)]
        last = np.zeros(len(a), bool)
        last[doc_ends[doc_ends > 0] - 1] = True
        keep = verified & (spaced | last[candidates])
        stop_a, stop_b = candidates[keep] + 1, at[keep] + 1
        at_a, at_b = np.r_[0, stop_a], np.r_[0, stop_b]
        # the ids of each window side by side: those of the first, then those of the second, marked
        mixed = np.empty(len(a) + len(b), "<u4")
        place = np.repeat(np.arange(len(stop_a)), np.diff(at_a))
        mixed[np.arange(len(a)) + at_b[place]] = a
        place = np.repeat(np.arange(len(stop_b)), np.diff(at_b))
        mixed[np.arange(len(b)) + at_a[place + 1]] = b.astype(np.uint32) | SECOND
        raw, edges = mixed.tobytes(), (4 * (at_a + at_b)).tolist()
        return at_a, at_b, [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
COUNTED = "pair long, total long"
_SCHEMA = pa.schema(
    [
        *((c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")),
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
        ("pair", pa.int64()),
        ("total", pa.int64()),
    ]
)


class Counts:
    """How often each pair was met, in sorted arrays."""

    def __init__(self) -> None:
        self.pairs, self.totals = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting, self.n = [], 0

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.waiting.append((pairs, times))
        self.n += len(pairs)
        if self.n > HELD_PAIRS:
            self.settle()

    def settle(self) -> None:
        pairs = np.concatenate([self.pairs, *(p for p, _ in self.waiting)])
        times = np.concatenate([self.totals, *(t for _, t in self.waiting)])
        self.pairs, at = np.unique(pairs, return_inverse=True)
        self.totals = np.zeros(len(self.pairs), np.int64)
        np.add.at(self.totals, at, times)
        self.waiting, self.n = [], 0

    def batch(self) -> pa.RecordBatch:
        self.settle()
        empty = [pa.nulls(len(self.pairs), t) for t in _SCHEMA.types[:-2]]
        out = pa.RecordBatch.from_arrays([*empty, pa.array(self.pairs), pa.array(self.totals)], schema=_SCHEMA)
        self.pairs, self.totals = np.empty(0, np.int64), np.empty(0, np.int64)
        return out


def _aligned(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tool, row = Counts(), aligner(first, second), TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for part in arrays.parts(batch.column(1), ROWS):
                rows, pairs, times = [], [], []
                for n_a, n_b, groups, links, text, codes, often in tool.align(part.to_pylist()):
                    rows.append((row, n_a, n_b, groups, links, hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
                    pairs.append(codes)
                    times.append(often)
                    counts.add(codes, often)
                    row += 1
                numbers, *own = (pa.array(x) for x in zip(*rows, strict=True))
                lists = [listed(list(map(len, pairs)), pa.array(np.concatenate(pairs))), listed(list(map(len, pairs)), pa.array(np.concatenate(times).astype(np.int32)))]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, batch.column(0).slice(at, len(part)), *own, *lists, none, none], schema=_SCHEMA)
                at += len(part)
                if len(counts.pairs) > HELD_PAIRS:
                    yield counts.batch()
        yield counts.batch()

    return run


def listed(sizes: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _scored(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, totals, best = frequent.value
        for whole in batches:
            for k in range(0, len(whole), SCORED_ROWS):
                batch = whole.slice(k, SCORED_ROWS)
                *kept, pairs, times = batch.columns
                x, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(batch)), pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
                at = np.searchsorted(codes, x)
                at[at == len(codes)] = 0
                known = codes[at] == x if len(codes) else np.zeros(len(x), bool)
                sums = [np.zeros(len(batch), np.int64) for _ in range(2)]
                for out, value in zip(sums, (best, totals), strict=True):
                    np.add.at(out, doc[known], n[known] * value[at[known]])
                rest = pa.StructArray.from_arrays([pa.array(x[~known]), pa.array(n[~known])], ["pair", "times"])
                rest = listed(np.bincount(doc[~known], minlength=len(batch)), rest)
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), rest], names=[*batch.schema.names[:-2], "n_best", "count_sum", "rest"])

    return run


def most_frequent(counts: DataFrame, at_most: int) -> pa.Table:
    """The rows of counts whose total is above a bound that at_most rows pass at the most, by pair."""
    octave = F.floor(F.log2("total") * 8).alias("octave")
    above, least = 0, None
    for r in counts.groupBy(octave).count().orderBy(F.desc("octave")).collect():  # 504 rows at the most
        above += r["count"]
        if above > at_most:
            break
        least = r["octave"]
    return counts.filter(F.lit(False) if least is None else F.floor(F.log2("total") * 8) >= least).toArrow().sort_by("pair")


def align(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    first is a byte-level vocabulary of the tokenizers library, second a
    sentencepiece model. A null or empty text, and one whose bytes either
    tokeniser does not keep, has no tokens: zeros and an empty digest. Ids may
    be null or repeated; a text of any length is aligned whole, in memory of
    about forty times its bytes. An empty table gives no rows; other columns
    are not read.
    """
    spark, scratch, paths = docs.sparkSession, Scratch(docs.sparkSession, "alignment"), default_paths()
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = scratch.save(columns.mapInArrow(_aligned(first or paths[0], second or paths[1]), f"{ALIGNED}, {COUNTED}"), "aligned")
    counts = scratch.save(found.filter("pair is not null").groupBy("pair").agg(F.sum("total").alias("total")), "counts")
    b = F.col("pair") % (1 << 32)
    most = counts.groupBy(b.alias("b")).agg(F.max("total").alias("most"))  # a row for each id of the second vocabulary at the most
    ranked = counts.join(F.broadcast(most), b == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    table = most_frequent(ranked, frequent)
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "total", "best")))
    rows = found.filter("row is not null").drop("pair", "total")
    kept = [(c, t) for c, t in rows.dtypes if c not in ("pairs", "times")]
    schema = ", ".join(f"{c} {t}" for c, t in kept) + ", n_best long, count_sum long, rest array<struct<pair:long,times:long>>"
    scored = scratch.save(rows.select(*(c for c, _ in kept), "pairs", "times").mapInArrow(_scored(known), schema), "scored")
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
    more = rare.join(ranked, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("total")).alias("more_sum"))
    sums = ((F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum")))
    return scored.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
