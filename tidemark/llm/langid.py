"""Language identification by nearest centroid.

A text is a vector of its byte pairs and triples (lower case, everything but
letters a space), hashed to DIMENSIONS, weighted by log frequency and inverse
document frequency, and of length one. Each language has several centroids
from spherical k-means; the closest by cosine names the language, and a text
that lies too far from it is rejected. How far is too far is learned by length:
sample texts are measured against centroids of the other half of their
language's sample, and so are the same texts with their letters shuffled. Where
nearly all real texts (KEPT) are nearer than nearly all shuffled ones, the bound
lies midway; where the two overlap, as for a few words, it keeps the real ones.
A language has bounds of its own for lengths of which it has LEAST_TEXTS; else
those of all languages together, and of longer texts where even these are few.
Document frequencies come from all documents that may be learned from;
centroids and bounds from at most SAMPLE of them per language, the first in the
order of a fixed hash. The model is collected: about 35 KB a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import PART_BYTES, chunks, parts, text_bytes
from .quality import fold
from .scratch import Scratch

DIMENSIONS = 2048
SAMPLE = 600
BROADCAST_LANGUAGES = 10_000  # with more values the table of their sizes is joined by shuffle
CENTROIDS = 4
ROUNDS = 12
KEPT = 0.995
SHUFFLED = 0.05  # the share of shuffled texts that may lie nearer than the distance that stands for them
#: Texts are compared among those of about as many different dimensions: short texts are far from any centroid.
LENGTHS = (20, 40, 70, 100, 150, 250, 400)
LEAST_TEXTS = 60
ROWS = 512  # texts whose counts are held at once
UNKNOWN = "und"
SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)
KEEP = np.full(256, 32, np.uint8)
KEEP[97:123] = np.arange(97, 123)
KEEP[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> np.ndarray:
    """How often each dimension occurs in each text of a large_string array."""
    raw, starts = text_bytes(pc.utf8_lower(texts))
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(starts))
    data = KEEP[raw]
    held = np.ones(len(data), bool)
    held[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])  # runs of spaces become one
    data, doc = data[held].astype(np.uint32), doc[held]
    out = np.zeros(n * DIMENSIONS, np.int32)
    for size in (2, 3):
        if len(data) < size:
            continue
        code = np.full(len(data) - size + 1, size, np.uint32)
        for k in range(size):
            code = code << np.uint32(8) | data[k : len(data) - size + 1 + k]
        inside = doc[size - 1 :] == doc[: len(doc) - size + 1]
        place = doc[: len(code)] * DIMENSIONS + (code * np.uint32(2654435761) >> SHIFT)
        out += np.bincount(place[inside], minlength=n * DIMENSIONS).astype(np.int32)
    return out.reshape(n, DIMENSIONS)


def all_counts(texts: pa.Array) -> np.ndarray:
    """counts(); a text of more than PART_BYTES is counted in pieces."""
    if len(texts) != 1 or len(raw := text_bytes(texts)[0]) <= PART_BYTES:
        return counts(texts)
    pieces = [raw[a:b].tobytes().decode(errors="ignore") for a, b in chunks(raw)]
    return sum(counts(pa.array([t], pa.large_string())) for t in pieces)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(all_counts(texts).astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def length_class(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, (x > 0).sum(axis=1), "right")


def cluster(x: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Centroids of length one by spherical k-means; the first is the most typical row, each next the row least like those before."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centroids = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    reach: np.ndarray  # by language and length: the largest distance that is not rejected

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number, the cosine and whether the text is rejected."""
        x = vectors(texts, self.idf)
        near = x @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(near)), best], 0, 1)
        language = self.owner[best]
        return language, cosine, 1 - cosine > self.reach[language, length_class(x)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for part in parts(batch.column(0), ROWS):
            seen += (all_counts(part) > 0).sum(axis=0)
            n += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.r_[n, seen], pa.int64())], ["dim", "n"])


def shuffled(text: str) -> str:
    """The text with its letters in another order, words and all else in place; no more of it than a bound needs."""
    at = [k for k, c in enumerate(text) if c.isalpha()]
    out, order = list(text), np.random.default_rng(len(at)).permutation(len(at))
    for k, j in zip(at, order.tolist(), strict=True):
        out[k] = text[at[j]]
    return "".join(out)


def _centroids(idf: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        whole = lambda texts: np.concatenate([vectors(part, idf) for part in parts(pa.array(texts, pa.large_string()), ROWS)])
        x = whole(group["text"])
        centroids = cluster(x).astype(np.float32)
        halves = [cluster(x[k::2]) if len(x) > 1 else centroids for k in (1, 0)]  # for each text those of the other half
        odd = whole(group["text"].map(shuffled))
        measured = []
        for rows in (x, odd):
            far = np.empty(len(rows))
            for k in (0, 1):
                far[k::2] = 1 - (rows[k::2] @ halves[k].T).max(axis=1) if len(rows[k::2]) else 0
            measured.append(far.tolist())
        more = [length_class(x).tolist(), *measured]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tobytes() for c in centroids], "length": [more[0]] * len(centroids), "real": [more[1]] * len(centroids), "odd": [more[2]] * len(centroids)})

    return run


def bound(real: np.ndarray, odd: np.ndarray) -> float:
    """The largest distance that is not rejected, from those of real and of shuffled texts."""
    near, far = np.quantile(real, KEPT), np.quantile(odd, SHUFFLED)
    return float((near + far) / 2 if near < far else near)


def bounds(length: list[np.ndarray], real: list[np.ndarray], odd: list[np.ndarray]) -> np.ndarray:
    """By language and length class: the language's own bound, else that of all languages, else with longer texts."""
    every = [np.concatenate(v) for v in (length, real, odd)]
    out = np.empty((len(length), len(LENGTHS) + 1))
    for k in range(out.shape[1]):
        stop = k
        while stop < out.shape[1] - 1 and ((every[0] >= k) & (every[0] <= stop)).sum() < LEAST_TEXTS:
            stop += 1
        pooled = (every[0] >= k) & (every[0] <= stop)
        if pooled.sum() < LEAST_TEXTS:  # few texts are as long: the longest ones there are
            pooled = every[0] >= np.sort(every[0])[-min(LEAST_TEXTS, len(every[0]))]
        for j, lengths in enumerate(length):
            own = lengths == k
            out[j, k] = bound(real[j][own], odd[j][own]) if own.sum() >= LEAST_TEXTS else bound(every[1][pooled], every[2][pooled])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> Model | None:
    """A model from the texts with a language outside the held-out fold; none where there are none with a letter."""
    learn = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    learn = learn.filter(fold("id", folds) != held_out).filter("lang is not null and text is not null")
    seen = {r.dim: r.n for r in learn.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}  # DIMENSIONS + 1 rows
    total = seen.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([seen.get(d, 0) for d in range(DIMENSIONS)]))).astype(np.float32) + np.float32(0.05)
    lettered = learn.filter(F.col("text").rlike(r"\p{L}"))
    sizes = Scratch(docs.sparkSession, "langid").save(learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes.hint("merge")
    share = F.expr("pmod(xxhash64(id), 1000003)") < F.lit(1000003.0 * 2 * SAMPLE) / F.col("n")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    sample = lettered.join(sizes, "lang").filter(share)
    sample = sample.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= SAMPLE).select("lang", "at", "text")
    rows = sorted(sample.groupBy("lang").applyInPandas(_centroids(idf), "lang string, centroid binary, length array<long>, real array<double>, odd array<double>").collect(), key=lambda r: (r.lang, r.centroid))
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    one = {r.lang: r for r in rows}
    reach = bounds(*[[np.array(one[x][name]) for x in languages] for name in ("length", "real", "odd")])
    return Model(idf, languages, np.array([languages.index(r.lang) for r in rows]), np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]), reach)


PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _identified(model: Model | None):
    def run(texts: pa.Array) -> pa.Array:
        names = pa.array([*(model.languages if model else []), UNKNOWN])
        lang, cosine, far = np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
        for part in parts(texts, ROWS):
            got = model.predict(part) if model else (np.zeros(len(part), np.int64), np.zeros(len(part)), np.ones(len(part), bool))
            blank = ~pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
            lang = np.r_[lang, np.where(blank, len(names) - 1, got[0])]
            cosine, far = np.r_[cosine, np.where(blank, 0.0, got[1])], np.r_[far, blank | got[2]]
        return pa.StructArray.from_arrays([names.take(pa.array(lang)), pa.array(cosine, pa.float64()), pa.array(far)], fields=list(PREDICTED))

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs with _tm_lang, _tm_score (the cosine) and _tm_rejected.

    A text that is null or has no letter is 'und', scores 0 and is rejected;
    so is every text where there is no model. Ties go to the language that
    sorts first. Repeated rows are judged alike. An empty table gives no rows.
    Columns of docs that start with _tm_ give way to the operator's own.
    """
    held = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("_tm_")]
    predict = F.arrow_udf(_identified(model), "lang string, score double, rejected boolean")
    found = docs.select(*held, predict(F.col(f"`{text_col}`")).alias("_tm_found"))
    return found.select(*held, *[F.col(f"_tm_found.{c}").alias(f"_tm_{c}") for c in ("lang", "score", "rejected")])
