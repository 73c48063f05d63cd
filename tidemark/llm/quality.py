"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by the
non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the sigmoid loss; where the second part of a step turns negative, its
gradient is reversed instead. The prior is estimated from positives and
unlabelled texts alone: a network fitted to one half of each scores the other,
and of all thresholds the share of unlabelled scores above one, over that of
positive scores, is least where only positives are; labels 0 are not read. The
features are shares of byte-class pairs and measures of repetition over the
whole text. Fitting reads at most POSITIVES + UNLABELLED documents, the first
in the order of a fixed hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import parts, text_bytes

POSITIVES, UNLABELLED = 6000, 12_000
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 60, 1500, 0.01, 11
CLASSES = 9
CLASS = np.full(256, 7, np.uint8)  # 7: other ASCII
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\r\n", b".,;:", b"!?")):
    CLASS[list(_bytes)] = _k
CLASS[128:] = 8


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text of a large_string array."""
    raw, starts = text_bytes(texts)
    n, size = len(texts), np.diff(starts)
    kind = CLASS[raw]
    doc = np.repeat(np.arange(n), size)
    inner = doc[1:] == doc[:-1] if len(doc) else np.empty(0, bool)
    pair = (doc[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:] if len(doc) else doc
    pairs = np.bincount(pair[inner], minlength=n * CLASSES**2).reshape(n, -1) / np.maximum(size - 1, 1)[:, None]

    split = pc.ascii_split_whitespace(texts)
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    flat = split.flatten().dictionary_encode()
    code, words, base = flat.indices.to_numpy().astype(np.int64), np.diff(at), len(flat.dictionary) + 1
    owner = np.repeat(np.arange(n), words)
    one, times = np.unique(owner * base + code, return_counts=True)
    distinct = np.bincount(one // base, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, one // base, times)
    inner = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][inner & (code[1:] == code[:-1])], minlength=n)
    two = np.unique(np.searchsorted(one, owner[1:] * base + code[1:])[inner] * base + code[:-1][inner])  # the first of a pair, as a place in one
    twos = np.bincount(one[two // base] // base, minlength=n)
    count = np.maximum(words, 1)
    more = np.column_stack([np.log1p(size), distinct / count, top / count, same / count, twos / count, np.log1p(words) * distinct / count, size / count / 10])
    return np.hstack([np.sqrt(pairs), more]).astype(np.float32)


class Model:
    """A network of one hidden layer; score() gives values from 0 to 1."""

    def __init__(self, width: int, rng: np.random.Generator) -> None:
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.w = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(self.inputs(x)) @ self.w[2] + self.w[3], -30, 30)))


def lower_envelope(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior: the least of P(score >= t | unlabelled) / P(score >= t | positive), each with its margin of error.

    The margin (of a bound on both shares that holds but for one case in ten)
    picks the threshold; the prior is the plain ratio there.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = ((above_u + margin) / above_p).argmin()
    return float(min(1.0, above_u[best] / above_p[best]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows; 1 where either has too few rows to be halved."""
    if min(len(positive), len(unlabelled)) < 4:
        return 1.0
    model = fit(positive[::2], unlabelled[::2], 0.5)
    return lower_envelope(model.score(positive[1::2]), model.score(unlabelled[1::2]))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk by Adam over shuffled batches."""
    rng = np.random.default_rng(SEED)
    model = Model(unlabelled.shape[1], rng)
    model.mean, model.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = model.inputs(positive), model.inputs(unlabelled)
    moments, step = [(np.zeros_like(w), np.zeros_like(w)) for w in model.w], 0
    for _ in range(EPOCHS):
        order_u, order_p = rng.permutation(len(u)), rng.permutation(len(p))
        rounds = max(1, len(u) // BATCH)
        for bu, bp in zip(np.array_split(order_u, rounds), np.array_split(np.resize(order_p, max(len(p), rounds)), rounds), strict=True):
            x = np.concatenate([p[bp], u[bu]])
            h = model.hidden(x)
            s = 1 / (1 + np.exp(-np.clip(h @ model.w[2] + model.w[3], -30, 30)))  # the loss of label -
            n_p, slope = len(bp), s * (1 - s)
            negative = s[n_p:].mean() - prior * s[:n_p].mean()
            if negative < 0:
                g = np.r_[prior * slope[:n_p] / n_p, -slope[n_p:] / len(bu)]
            else:
                g = np.r_[-2 * prior * slope[:n_p] / n_p, slope[n_p:] / len(bu)]
            back = np.outer(g, model.w[2]) * (h > 0)
            grads, step = [x.T @ back + 1e-4 * model.w[0], back.sum(axis=0), h.T @ g + 1e-4 * model.w[2], np.array([g.sum()])], step + 1
            for k, d in enumerate(grads):
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                model.w[k] = model.w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(part) for part in parts(batch.column(2))]
        if x:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([row.tobytes() for row in np.concatenate(x)], pa.binary())], ["id", "kind", "x"])


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(part)) if model else np.full(len(part), 0.5) for part in parts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*scores, np.empty(0)]), pa.float64())], ["doc_id", "score"])

    return run


def fold(id_col: str, folds: int) -> Column:
    """The crc32 of an id as text, modulo folds."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> Model | None:
    """A model from the rows outside fold 0; none where they hold no positive or no document."""
    ids, hashed = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{id_col}`"))
    learn = labels.filter(fold(id_col, folds) != 0).groupBy(ids.alias("id")).agg(F.min("quality").alias("quality"))
    trusted = learn.filter("quality = 1").orderBy(F.xxhash64("id"), "id").limit(POSITIVES).select("id", F.lit(1).alias("kind"))
    web = docs.filter(fold(id_col, folds) != 0).select(ids.alias("id"), hashed.alias("h")).distinct().orderBy("h", "id").limit(UNLABELLED).select("id", F.lit(0).alias("kind"))
    chosen = F.broadcast(trusted.union(web))  # at most POSITIVES + UNLABELLED rows
    found = docs.select(ids.alias("id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "id").select("id", "kind", "text").mapInArrow(_featured, "id string, kind int, x binary")
    rows = found.groupBy("id", "kind").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id"), "id").collect()  # one row for each chosen id, however often it stands
    x = {k: [np.frombuffer(r.x, np.float32) for r in rows if r.kind == k] for k in (0, 1)}
    if not x[0] or not x[1]:
        return None
    positive, unlabelled = np.stack(x[1]), np.stack(x[0])
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text counts as empty and is scored; repeated rows score alike; a
    null id is not held out; without a model every score is 0.5. An empty
    table gives no rows; other columns are not read.
    """
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scored = columns.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
