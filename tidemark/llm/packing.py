"""Cost-balanced packing of token documents into sequences of fixed capacity.

A task packs its own documents, a shard of bounded token count at a time, and
so needs no shuffle: sequences of a shard are as many as its tokens fill, and
the tokens left over get sequences of power-of-two lengths, which need no
padding. Runs of a whole capacity take a sequence each; what remains of every
document is dealt in descending order of cost (linear plus quadratic in its
length) to the sequence of least cost that has room for it, and is cut where
none has. Sequence ids carry the partition's number in their upper half; the
packing is the same whenever the input is split alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 4096
SHARD_TOKENS = 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def cost(length: np.ndarray | float) -> np.ndarray | float:
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start, length, sequence, offset, tokens of the sequence) of each piece; every sequence is full."""
    total = sum(lengths)
    full, tail = divmod(total, capacity)
    room = np.array([capacity] * full + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1], np.int64)
    size, load, out, rest, opened = room.copy(), np.zeros(len(room)), [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            out.append((doc, start, capacity, opened, 0, capacity))
            room[opened] = 0
            opened += 1
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    rest.sort(key=lambda x: (-x[2], x[0]))  # cost rises with length
    for doc, start, n in rest:
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            at = int(np.where(fits, load, np.inf).argmin())
            take = min(n, int(room[at]))
            out.append((doc, start, take, at, int(size[at] - room[at]), int(size[at])))
            room[at] -= take
            load[at] += cost(take)
            start, n = start + take, n - take
    return out


def _packed(path: str, end_id: int, capacity: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, names, docs, held = TaskContext.get().partitionId() << 32, [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal base, names, docs, held
            rows = [(names[d], start, n, tokens.crc32(docs[d][start : start + n]), len(docs[d]), base + at, offset, size) for d, start, n, at, offset, size in assign([len(x) for x in docs], capacity)]
            base += 1 + max(r[5] for r in rows) - base
            names, docs, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], FIELDS)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1), path, end_id), strict=True):
                names.append(name)
                docs.append(ids)
                held += len(ids)
                if held >= shard_tokens:
                    yield shard()
        if docs:
            yield shard()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: where its ids stand in the document and in which sequence they lie.

    A null or empty text is its end id alone. Repeated rows and ids are
    documents of their own; a null id stays null. A text longer than a shard
    is a shard by itself. An empty table gives no rows; other columns are not
    read.
    """
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return columns.mapInArrow(_packed(vocabulary or tokens.default_vocabulary(), end_id, capacity, shard_tokens), SCHEMA)
