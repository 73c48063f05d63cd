"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components.

A fingerprint is cut into BLOCKS blocks. Two fingerprints at a distance of at
most D agree on at least BLOCKS - D whole blocks, so they meet under one of
the C(BLOCKS, D) keys made of BLOCKS - D blocks each (with 5 blocks and
distance 3: ten keys of about 26 bits). Equal fingerprints are one row before
that, so copies cost nothing, and within a key only a spanning forest of the
verified links comes out, never all pairs. A key with more than BUCKET
fingerprints is dealt as pairs of parts, each pair of parts meeting in one
place, so no task holds an unbounded group and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

SHINGLE = 3
SEED = 42
BLOCKS = 5
DISTANCE = 3
BUCKET = 20_000
#: For each byte value a word whose eight byte lanes are its bits, so that adding words counts bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer; zero for no words or null."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):  # a lane holds up to 255
        part = hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8)
        counts += np.add.reduceat(LANES[part], np.arange(0, len(part), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).dictionary_encode()
        found = pa.array([fingerprint(t) for t in texts.dictionary.to_pylist()] or [0], pa.int64())
        prints = found.take(texts.indices).fill_null(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], prints], ["doc_id", *batch.schema.names[2:], "fp"])


def close(a: np.ndarray, b: np.ndarray | np.int64, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance  # of signed integers it would count the absolute value's bits


def forest(points: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what distance connects: each point is linked to the one it was found from."""
    out, left = [], points
    while len(left) > 1:
        left, open_ = left[1:], [left[0]]
        while open_ and len(left):
            at = open_.pop()
            near = close(left, at, distance)
            if near.any():
                new, left = left[near], left[~near]
                open_.extend(new)
                out.append((np.full(len(new), at), new))
    return out


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            starts, stops = np.r_[0, edge], np.r_[edge, len(rows)]
            fps, size = rows[:, 4], stops - starts
            two = starts[size == 2]
            two = two[close(fps[two], fps[two + 1], distance)]
            pairs = [(fps[two], fps[two + 1])]
            for s, e in zip(starts[size > 2], stops[size > 2], strict=True):
                pairs += forest(fps[s:e], distance)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1)], ["a", "b"])

        for batch in batches:  # sorted by key; the last key of a batch may go on in the next
            rows = np.concatenate([held, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])])
            if not len(rows):
                continue
            tail = len(rows) - int(np.argmax((rows[::-1, :4] != rows[-1, :4]).any(axis=1))) if (rows[0, :4] != rows[-1, :4]).any() else 0
            held = rows[tail:]
            if tail:
                yield found(rows[:tail])
        if len(held):
            yield found(held)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carried columns, fp) for each row of docs."""
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *carry)
    kinds = dict(columns.dtypes)
    return columns.mapInArrow(_fingerprints, ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in carry), "fp long"]))


def links(distinct: DataFrame, scratch: Scratch, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints fp whose components are those of all pairs within distance."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in kept) for kept in combinations(range(blocks), blocks - distance)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for k, m in enumerate(masks)]))
    keyed = distinct.select("fp", key.alias("key")).select("key.k", "key.part", "fp")
    large = scratch.save(keyed.groupBy("k", "part").count().filter(f"count > {bucket}").select("k", "part", F.ceil(F.col("count") / bucket).cast("int").alias("parts")), "large")
    dealt = keyed.join(large, ["k", "part"], "left").withColumn("own", F.expr("pmod(xxhash64(fp), coalesce(parts, 1))").cast("int"))
    other = F.expr("CASE WHEN parts IS NULL THEN array(0) ELSE filter(sequence(0, parts - 1), j -> j <> own) END")
    dealt = dealt.select("k", "part", "own", F.explode(other).alias("other"), "fp").select("k", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return dealt.repartition("k", "part", "i", "j").sortWithinPartitions("k", "part", "i", "j", "fp").mapInArrow(_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carried columns, fp, component, component_id): component_id is the least doc_id that links reach.

    component is a fingerprint that stands for the whole component, also where
    no row of it has an id. A null text counts as empty and has fingerprint
    zero, which links like any other. Each row of docs gives one row, rows with
    repeated ids included; a null id is no component's least. An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, carry), "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, scratch), scratch)
    rooted = scratch.save(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.save(rooted.join(least, "root").select("fp", F.col("root").alias("component"), "component_id"), "named")
    scratch.drop("distinct", "large", "rooted", "least")
    return prints.join(named, "fp").select("doc_id", *carry, "fp", "component", "component_id")
