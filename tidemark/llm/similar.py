"""SimHash near-duplicates by similarity of shingle sets: wide fingerprints, blocks of several splittings, Hamming check.

A fingerprint of BITS bits is taken over a text's distinct shingles. A pair of
sets of Jaccard similarity s has a cosine of 2s / (1 + s) where the sets are of
one size (little more where they are not), so its bits differ with a chance of
arccos(2s / (1 + s)) / pi each: 0.152 at 0.8. Pairs that differ in SLACK
standard deviations less than that share are linked; up to SLACK more, they are
linked where the sets themselves have the similarity.

To meet, a pair must agree on a whole block. The bits are put into several
fixed orders, and each order is split into disjoint blocks of some width. The
width follows the number of fingerprints, so that a block's value is shared by
about HELD unrelated ones at any size of the corpus, and the number of blocks
follows from the width, so that a pair at the similarity itself meets with a
chance of RECALL, and closer pairs more surely. Both follow from parameters,
not from the data; nothing is capped or dropped.

Equal fingerprints are one row before that. Within a block only a minimum
spanning forest of the close pairs comes out: whatever bound one sets below, its
links connect what all pairs within that bound connect. A block with more than
bucket fingerprints is dealt as pairs of parts, each pair meeting in one place,
so no task holds an unbounded group and no link is lost. Sets are compared only
for links between what sure links have not joined yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .simhash import LANES

SHINGLE = 5
SIMILARITY = 0.8
LONGS = 4
BITS = 64 * LONGS
PRINT = [f"p{k}" for k in range(LONGS)]
SLACK = 1.3
RECALL = 0.95
HELD = 16
NARROWEST = 16  # bits of a block
BUCKET = 5_000  # a pair of parts takes some 5 s of one core
SMALL = 32  # prints of a group that are compared by shifts over all groups of a batch
PART = 255 * 256  # hashes counted at once; a byte lane holds up to 255


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct word shingles, ascending; none for no words or null."""
    words = (text or b"").lower().split()
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The print of a text's distinct word shingles, LONGS integers; all zero without any."""
    hashes = shingles(text, shingle)
    out = np.zeros(LONGS, np.int64)
    if not len(hashes):
        return out
    for k in range(LONGS):
        bits = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)  # a splitmix64 step for each long
        bits = (bits ^ (bits >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = (bits ^ (bits >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits ^= bits >> np.uint64(31)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(bits), PART):
            lanes = LANES[bits[at : at + PART].view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
            counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(bits), bitorder="little").view(np.int64)[0]
    return out


def share(similarity: float) -> float:
    """The chance that a bit differs between prints of sets of one size and this similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bounds(similarity: float) -> tuple[int, int]:
    """The most differing bits of a sure link, and of one whose sets are to be compared."""
    p = share(similarity)
    slack = SLACK * math.sqrt(BITS * p * (1 - p))
    return math.floor(BITS * p - slack), math.floor(BITS * p + slack)


def blocks(prints: int, similarity: float) -> np.ndarray:
    """The bit numbers of each block for a corpus of so many prints, a row a block."""
    width = max(NARROWEST, math.ceil(math.log2(max(prints, 1) / HELD)))
    wanted = math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - share(similarity)) ** width)))
    each, rng = BITS // width, np.random.default_rng(11)
    orders = [rng.permutation(BITS)[: each * width].reshape(each, width) for _ in range(-(-wanted // each))]
    return np.concatenate(orders)[:wanted]


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null(b"").dictionary_encode()
            found = np.array([fingerprint(t, shingle) for t in texts.dictionary.to_pylist()], np.int64).reshape(-1, LONGS)
            columns = [pa.array(c) for c in found[texts.indices.to_numpy()].T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], ["doc_id", *batch.schema.names[2:], *PRINT])

    return run


def _keys(cut: np.ndarray):
    """A row for each print and block: the block's number and value as one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = cut.shape[1]
        weights = 1 << np.arange(width)
        for batch in batches:
            points = np.column_stack([batch.column(1 + k).to_numpy() for k in range(LONGS)])
            bits = np.unpackbits(np.ascontiguousarray(points).view(np.uint8), axis=1, bitorder="little")
            for k, of in enumerate(cut):
                key = (k << width) + bits[:, of].astype(np.int64) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", "node", *PRINT])

    return run


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)


def forest(points: np.ndarray, most: int) -> np.ndarray:
    """Rows (one, other, bits apart): the links up to most of a minimum spanning tree."""
    out, left, at = [], np.arange(1, len(points)), 0
    best, source = np.full(len(points), BITS + 1), np.zeros(len(points), np.int64)
    while len(left):
        far = apart(points[left], points[at])
        nearer = far < best[left]
        best[left[nearer]], source[left[nearer]] = far[nearer], at
        k = int(best[left].argmin())
        at = left[k]
        if best[at] <= most:
            out.append((source[at], at, best[at]))
        left = np.delete(left, k)
    return np.array(out, np.int64).reshape(-1, 3)


def group_links(rows: np.ndarray, most: int) -> np.ndarray:
    """Links (node, node, bits apart) within groups: rows are (three columns that name the group, node, print), sorted by group."""
    edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
    starts, stops = np.r_[0, edge], np.r_[edge, len(rows)]
    group, nodes, points = np.repeat(np.arange(len(starts)), stops - starts), rows[:, 3], np.ascontiguousarray(rows[:, 4:])
    linked = stops - starts > SMALL
    small = ~linked[group]
    for far in range(1, SMALL):  # most groups hold no link: all are tried at once, row against row
        at = np.flatnonzero((group[far:] == group[:-far]) & small[far:])
        if not len(at):
            break
        linked[group[at[apart(points[at], points[at + far]) <= most]]] = True
    found = [np.empty((0, 3), np.int64)]
    for s, e in zip(starts[linked], stops[linked], strict=True):
        tree = forest(points[s:e], most)
        found.append(np.column_stack([nodes[s + tree[:, 0]], nodes[s + tree[:, 1]], tree[:, 2]]))
    return np.concatenate(found)


def _links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4 + LONGS), np.int64)
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in found.T], ["a", "b", "bits"])
        for batch in batches:  # sorted by group; the last one of a batch may go on in the next
            rows = np.concatenate([held, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])])
            if not len(rows):
                continue
            other = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            tail = int(other[-1]) + 1 if len(other) else 0
            held = rows[tail:]
            if tail:
                yield batch_of(group_links(rows[:tail], most))
        if len(held):
            yield batch_of(group_links(held, most))

    return run


def links(distinct: DataFrame, scratch: Scratch, cut: np.ndarray, most: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b, bits) links between nodes of distinct (node, print): they connect what pairs that meet and are close connect."""
    names = ["node", *PRINT]
    keyed = distinct.select(*names).mapInArrow(_keys(cut), "key long, node long, " + ", ".join(f"{p} long" for p in PRINT))
    many = keyed.groupBy("key").count().filter(f"count > {bucket}")
    large = scratch.save(many.select("key", F.ceil(F.col("count") / bucket).cast("int").alias("parts")), "large")
    dealt = keyed.join(large, "key", "left").withColumn("own", F.expr("pmod(xxhash64(node), coalesce(parts, 1))").cast("int"))
    other = F.expr("CASE WHEN parts IS NULL THEN array(0) ELSE filter(sequence(0, parts - 1), j -> j <> own) END")
    dealt = dealt.select("key", "own", F.explode(other).alias("other"), *names)
    met = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *names)
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links(most), "a long, b long, bits long")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a set is as large as its text: one at a time
                found = shingles(batch.column(1)[k].as_py(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([found], pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def alike(pairs: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b, ...) whose texts (node, text) have shingle sets of that similarity; hashes of 64 bits stand for shingles."""
    sets = scratch.save(texts.mapInArrow(_sets(shingle), "node long, shingles array<long>"), "sets")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", both)
    enough = F.col("both") >= similarity * (F.size("a_set") + F.size("b_set") - F.col("both"))
    return met.filter(enough).select(*pairs.columns)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, carried columns, component, component_id): component_id is the least doc_id that links reach.

    component is a number that stands for the whole component in this call, also
    where no row of it has an id. A null text counts as empty; empty texts are
    one component. A text of fewer words than a shingle has all of them as its
    one shingle. Each row of docs gives one row, rows with repeated ids
    included; a null id is no component's least. An empty table gives no rows.
    Carried columns bear none of the names used here.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *carry)
    kinds, longs = dict(columns.dtypes), [f"{p} long" for p in PRINT]
    found = columns.mapInArrow(_prints(shingle), ", ".join(["doc_id long", "text_hash long", *(f"{c} {kinds[c]}" for c in carry), *longs]))
    prints = scratch.save(found, "prints")
    distinct = prints.groupBy(*PRINT).agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"))
    distinct = scratch.save(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    sure, most = bounds(similarity)
    met = scratch.save(links(distinct, scratch, blocks(distinct.count(), similarity), most, bucket), "met")
    first = components(met.filter(f"bits <= {sure}").select("a", "b"), scratch)
    first = scratch.save(distinct.join(first, "node", "left").select("node", "text_hash", F.coalesce("root", "node").alias("root")), "first")

    up = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    open_ = met.filter(f"bits > {sure}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    open_ = scratch.save(open_.join(up("a"), "a").join(up("b"), "b").filter("a_root <> b_root"), "open")
    asked = open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct().join(first, "node").select("node", "text_hash")
    texts = columns.select("text_hash", "text").join(asked, "text_hash").select("node", "text").dropDuplicates(["node"])
    seen = alike(open_, texts, scratch, similarity, shingle).select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    second = components(seen, scratch).withColumnRenamed("root", "last")

    rooted = first.join(second.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("last", "root").alias("component"))
    rooted = scratch.save(distinct.select("node", "least", *PRINT).join(rooted, "node").select(*PRINT, "least", "component"), "rooted")
    least = scratch.save(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = scratch.save(rooted.join(least, "component").select(*PRINT, "component", "component_id"), "named")
    scratch.drop("distinct", "large", "met", "first", "open", "sets", "rooted", "least")
    return prints.join(named, PRINT).select("doc_id", *carry, "component", "component_id")
