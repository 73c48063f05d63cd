"""Substring deduplication over sliding spans of sentences.

Runs of consecutive sentences with at least SENTENCES of them and LEAST_WORDS
words are hashed to 128 bits: from each sentence on the shortest such run, and
up to each sentence the shortest one. Whatever longer run occurs again, every
sentence of it lies in one of these, so they stand for every run. A global
count of half the hash tells which can occur again; of those the whole hash
gives the first place, and the sentences that any other occurrence covers are
removed. First means least id (null last), then the earlier row, then the
earlier position, so the first copy of a passage stays where it is.

A sentence ends at a line break or at . ! ? before white space; one of more
than LONG words (a table, a text without stops) is cut behind the word of least
hash in each window of WINDOW words, so that equal passages are cut alike
wherever they stand and no two cuts are more than WINDOW words apart. Of a
passage without stops of 51 words, at most 16 at either end lie outside units
that all its copies share, so a run of 18 or more is left.
Words are runs without ASCII white space. One of more than WIDE bytes, and one
in a script without spaces, counts as several: each character of such a script,
and otherwise pieces cut in the same way behind characters.
Sentences are compared by their words, without regard to case or spacing.

A batch of texts is split and hashed as a whole in numpy: a run's hash is a
difference of prefix sums of word hashes, each times a power of its place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import parts, text_bytes
from .scratch import Scratch

SENTENCES = 2
LEAST_WORDS = 18
LONG = 16
WINDOW = 8  # a long sentence is cut at least once in so many words
WIDE = 80
GRAM, PIECE = 4, 16  # a wide word's cuts: characters hashed at once, and positions in a window
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
STOP = np.isin(np.arange(256), list(b".!?"))
#: Odd multipliers of the two halves of a hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NO_SPACES = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff60\U00020000-\U0003ffff"  # Thai to Khmer, kana, Han
_PART = re.compile(f"[{_NO_SPACES}]|[^{_NO_SPACES}]+")


def cuts(hashes: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """The places of the least hash, the last of equal ones, of all windows that lie within one owner."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    inside = np.flatnonzero(owner[window - 1 :] == owner[: len(views)])
    return np.unique(inside + window - 1 - views[inside, ::-1].argmin(axis=1))


def pieces(word: str) -> list[int]:
    """Sizes in bytes of what a wide word, or one in a script without spaces, counts as."""
    out = []
    for m in _PART.finditer(word):
        part = m[0]
        if len(part.encode()) > WIDE:
            grams = np.array([zlib.crc32(part[k : k + GRAM].lower().encode()) for k in range(len(part) - GRAM + 1)])
            edges = [0, *(k + GRAM for k in cuts(grams, np.zeros(len(grams)), PIECE).tolist() if k + GRAM < len(part)), len(part)]
            out += [len(part[a:b].encode()) for a, b in zip(edges, edges[1:], strict=False)]
        else:
            out.append(len(part.encode()))
    return out


@dataclass
class Units:
    """The sentences of some texts; they cover each text that has a word, each with the white space behind it."""

    doc: np.ndarray  # of each unit
    start: np.ndarray  # the byte of its text where a unit begins; the first one at 0
    word: np.ndarray  # the first word of each unit, and the number of all words at the end
    sums: tuple[np.ndarray, np.ndarray]  # prefix sums of word hashes

    def hashes(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit values of each run of units from first to before stop."""
        a, b = self.word[first], self.word[stop]
        return tuple(((s[b] - s[a]) * powers(pow(base, -1, 1 << 64), len(s))[a]).view(np.int64) for s, base in zip(self.sums, BASES, strict=True))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 1 << 16), base, np.uint64)])
        if n < 1 << 20:
            _POWERS[base] = held
    return held[:n]


def units(texts: pa.Array) -> Units:
    """The sentences of each text of a large_string array."""
    raw, starts = text_bytes(texts)
    solid = ~SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = starts[:-1][np.diff(starts) > 0]
    begins[heads] = solid[heads]
    begin = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[heads[1:] - 1] = solid[heads[1:] - 1]
    end = np.flatnonzero(ends) + 1

    other = np.cumsum(np.r_[0, raw >= 0xE0])  # the first byte of a character that may belong to a script without spaces
    odd = np.flatnonzero((end - begin > WIDE) | (other[end] > other[begin]))
    found = [(k, p) for k in odd.tolist() if len(p := pieces(raw[begin[k] : end[k]].tobytes().decode())) > 1]
    last = np.ones(len(begin), bool)  # of its word's pieces
    if found:
        counts = np.ones(len(begin), np.int64)
        counts[[k for k, _ in found]] = [len(p) for _, p in found]
        at = np.cumsum(counts) - counts
        size, begin = np.repeat(end - begin, counts), np.repeat(begin, counts)
        for k, p in found:
            size[at[k] : at[k] + len(p)] = p
            begin[at[k] : at[k] + len(p)] += np.cumsum(p) - p
        end, last = begin + size, np.zeros(len(begin), bool)
        last[at + counts - 1] = True
    doc = np.searchsorted(starts, begin, "right") - 1

    closed = last & STOP[raw[end - 1]] if len(end) else last
    lines = np.searchsorted(begin, np.flatnonzero(raw == 10)) - 1
    closed[lines[lines >= 0]] = True
    closed[np.flatnonzero(np.diff(doc, append=-1))] = True

    size = end - begin
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[solid]))).dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, pc.utf8_lower(words.dictionary).cast(pa.large_binary()).to_pylist()))
    own = np.frombuffer(digests, "<u8").reshape(-1, 2)[words.indices.to_numpy()] if len(begin) else np.empty((0, 2), np.uint64)

    sentence = np.cumsum(closed) - closed
    long = np.flatnonzero((np.bincount(sentence) > LONG)[sentence]) if len(begin) else np.empty(0, np.int64)
    closed[long[cuts(own[long, 0], sentence[long], WINDOW)]] = True

    word = np.r_[0, np.flatnonzero(closed) + 1]
    first = word[:-1]
    start = begin[first] - starts[doc[first]]
    start[np.diff(doc[first], prepend=-1) > 0] = 0
    sums = tuple(np.r_[np.uint64(0), np.cumsum(own[:, k] * powers(base, len(own)), dtype=np.uint64)] for k, base in enumerate(BASES))
    return Units(doc[first], start, word, sums)


def runs(found: Units) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of the shortest run from each unit on and up to each unit, where its text holds one."""
    n, word = len(found.doc), found.word
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(found.doc)) + 1
    low = np.repeat(np.r_[0, edge], np.diff(np.r_[0, edge, n]))  # the first unit of each unit's text, and the end of its last
    high = np.repeat(np.r_[edge, n], np.diff(np.r_[0, edge, n]))
    unit = np.arange(n)
    stop = np.maximum(unit + SENTENCES, np.searchsorted(word, word[:-1] + LEAST_WORDS))
    back = np.minimum(unit + 1 - SENTENCES, np.searchsorted(word, word[1:] - LEAST_WORDS, "right") - 1)
    ahead = stop <= high
    behind = (back >= low) & (stop[np.maximum(back, 0)] != unit + 1)
    return np.r_[unit[ahead], back[behind]], np.r_[stop[ahead], unit[behind] + 1]


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch.column(0)):
            found = units(part)
            yield pa.RecordBatch.from_arrays([pa.array(found.hashes(*runs(found))[0])], ["h1"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "row", "first", "length", "h1", "h2"]
    for batch in batches:
        at = 0
        for part in parts(batch.column(2)):
            found = units(part)
            first, stop = runs(found)
            doc = found.doc[first]
            row = pa.array(at + doc)
            base = np.searchsorted(found.doc, doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(first - base, pa.int32()), pa.array(stop - first, pa.int32()), *map(pa.array, found.hashes(first, stop))], names)
            at += len(part)


def removed(texts: pa.Array, gone: list) -> list[tuple[str | None, int, int]]:
    """What stays of each text without the given runs of units, and how many units and words go; nothing for null."""
    out, at = [], 0
    for part in parts(texts):
        found = units(part)
        raw, starts = text_bytes(part)
        edges = np.searchsorted(found.doc, np.arange(len(part) + 1))
        for k in range(len(part)):
            if not texts[at].is_valid:
                out.append((None, 0, 0))
                at += 1
                continue
            a, b = edges[k], edges[k + 1]
            marks = np.zeros(b - a + 1, np.int64)
            for run in gone[at] or []:
                marks[run["first"]] += 1
                marks[run["first"] + run["length"]] -= 1
            drop = np.cumsum(marks[:-1]) > 0
            text = raw[starts[k] : starts[k + 1]]
            sizes = np.diff(np.r_[found.start[a:b], len(text)])
            kept = text[np.repeat(~drop, sizes)].tobytes() if b > a else text.tobytes()
            out.append((kept.decode(), int(drop.sum()), int(np.diff(found.word[a : b + 1])[drop].sum())))
            at += 1
    return out


CLEANED = pa.struct([("text", pa.string()), ("n_removed", pa.int64()), ("words_removed", pa.int64())])


def _cleaned(text: pa.Array, gone: pa.Array) -> pa.Array:
    rows = removed(text.cast(pa.large_string()), gone.to_pylist())
    return pa.array([dict(zip(("text", "n_removed", "words_removed"), r, strict=True)) for r in rows], CLEANED)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_removed, words_removed) of every row; text is what stays.

    Repeats within a text count like those between texts. Every row is a
    document of its own: rows that share an id follow one another in the order
    of the table, rows with a null id come last, and each loses only what a
    place before it holds. A null text stays null and an empty one empty. An
    empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    rows = scratch.save(rows, "rows")
    texts = rows.filter("text is not null")
    halves = texts.select("text").mapInArrow(_halves, "h1 long")  # half a hash is little to move, and leaves few runs; to hash anew is cheaper than to keep all
    twice = scratch.save(halves.groupBy("h1").count().filter("count > 1").select("h1"), "twice")
    found = texts.mapInArrow(_runs, "id long, row long, first int, length int, h1 long, h2 long")
    again = scratch.save(found.join(twice.hint("merge"), "h1"), "again")
    scratch.drop("twice")
    place = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "row", "first")
    counted = again.groupBy("h1", "h2").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.save(counted.filter("n > 1").select("h1", "h2", "kept.row", "kept.first").toDF("h1", "h2", "kept_row", "kept_first"), "repeated")
    covered = again.join(repeated.hint("merge"), ["h1", "h2"]).filter("row <> kept_row or first <> kept_first")
    gone = covered.groupBy("row").agg(F.collect_set(F.struct("first", "length")).alias("gone"))  # no more than twice the sentences of a text
    gone = scratch.save(gone, "gone")
    scratch.drop("again", "repeated")
    cleaned = F.arrow_udf(_cleaned, "text string, n_removed long, words_removed long")
    joined = rows.join(gone.hint("merge"), "row", "left").withColumn("cleaned", cleaned(F.when(F.col("gone").isNotNull(), F.col("text")), "gone"))
    hit = F.col("gone").isNotNull()
    return joined.select(
        F.col("id").alias("doc_id"), F.when(hit, F.col("cleaned.text")).otherwise(F.col("text")).alias("text"),
        *[F.when(hit, F.col(f"cleaned.{c}")).otherwise(F.lit(0)).cast("long").alias(c) for c in ("n_removed", "words_removed")],
    )
