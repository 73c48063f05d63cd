"""Token files of patched frame-of-reference blocks.

A file holds the ids of its documents end to end in blocks of 128. A block
stores its minimum, and every id less the minimum in as many bits as a share
PERCENTILE of them need; what does not fit keeps its low bits there and its
high bits in a list of exceptions behind. An index of block starts and a table
of documents follow, so a reader can begin at any block:

    magic | blocks | ids, validity and starts of documents | block starts | footer
    block: minimum u32, width u8, exceptions u8, 16 x width bytes, positions u8 each, high bits u32 each
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch

MAGIC = b"TMPFOR01"
BLOCK = 128
PERCENTILE = 0.9
CHUNK = 2048  # blocks that are encoded or decoded at once
HEAD = 6
FOOTER = struct.Struct("<QQQQQ8s")
END_ID = 1


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of whole blocks (m x BLOCK ids), and the size of each."""
    x = ids.astype(np.int64).reshape(-1, BLOCK)
    least = x.min(axis=1)
    x = x - least[:, None]
    bits = np.frexp(x.astype(np.float64))[1]  # of an integer: its bit length
    width = np.sort(bits, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1]
    large = bits > width[:, None]
    extra = large.sum(axis=1)
    sizes = HEAD + BLOCK // 8 * width + 5 * extra
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4], out[starts + 5] = width, extra
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = np.packbits((x[rows][:, :, None] >> np.arange(w) & 1).astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        out[(starts[rows] + HEAD)[:, None] + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(large)
    rank = np.arange(len(row)) - (np.cumsum(extra) - extra)[row]
    at = (starts + HEAD + BLOCK // 8 * width)[row]
    out[at + rank] = col
    out[(at + extra[row] + 4 * rank)[:, None] + np.arange(4)] = (x[row, col] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), sizes


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at starts in data."""
    raw = np.frombuffer(data, np.uint8)
    least = np.ascontiguousarray(raw[starts[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.int64)
    width, extra = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    x = np.zeros((len(starts), BLOCK), np.int64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(raw[(starts[rows] + HEAD)[:, None] + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little")
        x[rows] = bits.reshape(len(rows), BLOCK, w) @ (1 << np.arange(w))
    row = np.repeat(np.arange(len(starts)), extra)
    rank = np.arange(len(row)) - (np.cumsum(extra) - extra)[row]
    at = (starts + HEAD + BLOCK // 8 * width)[row]
    high = np.ascontiguousarray(raw[(at + extra[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.int64)
    x[row, raw[at + rank]] |= high << width[row]
    return (x + least[:, None]).astype("<u4").ravel()


class Writer:
    """One file; it has its name only once it is whole, so a lost task leaves none behind that counts."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.docs, self.starts, self.sizes, self.held, self.n_held, self.n = [], [0], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= CHUNK * BLOCK:
            self.flush(self.n_held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        for at in range(0, n, CHUNK * BLOCK):
            data, sizes = encode_blocks(ids[at : min(n, at + CHUNK * BLOCK)])
            self.out.write(data)
            self.sizes.append(sizes)
        self.held, self.n_held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        if self.n_held:
            last = self.held[-1][-1:]
            self.held.append(np.repeat(last, -self.n_held % BLOCK))
            self.flush(self.n_held + -self.n_held % BLOCK)
        sizes = np.concatenate(self.sizes) if self.sizes else np.empty(0, np.int64)
        blocks = len(MAGIC) + np.r_[0, np.cumsum(sizes)]
        valid = np.array([d is not None for d in self.docs], np.uint8)
        table = np.array([d or 0 for d in self.docs], "<i8").tobytes() + valid.tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(table + blocks.astype("<u8").tobytes() + FOOTER.pack(len(self.docs), self.n, len(sizes), int(blocks[-1]), int(blocks[-1]) + len(table), MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    def __init__(self, uri: str) -> None:
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        self.n_docs, self.n, n_blocks, at_docs, at_blocks, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        table = self.file.read_at(at_blocks - at_docs, at_docs)
        k = self.n_docs
        self.ids, self.valid, self.starts = np.frombuffer(table, "<i8", k), np.frombuffer(table, np.uint8, k, 8 * k).astype(bool), np.frombuffer(table, "<u8", k + 1, 9 * k).astype(np.int64)
        self.blocks = np.frombuffer(self.file.read_at(8 * (n_blocks + 1), at_blocks), "<u8").astype(np.int64)

    def tokens(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from start to before stop, in parts of bounded size; the index finds their blocks."""
        for first in range(start // BLOCK, -(-stop // BLOCK), CHUNK):
            last = min(first + CHUNK, -(-stop // BLOCK))
            at = self.blocks[first : last + 1]
            ids = decode_blocks(self.file.read_at(int(at[-1] - at[0]), int(at[0])), at[:-1] - at[0])
            yield ids[max(0, start - first * BLOCK) : stop - first * BLOCK]


def _written(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        uri = f"{folder}/part-{part:06d}-{TaskContext.get().taskAttemptId()}.tok"
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1), path, end_id), strict=True):
                out = out or Writer(uri)
                out.add(name, ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(out.docs)], "n_tokens": [out.n]})

    return run


def write(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write docs in ascending order of their id; the table of files (part, uri, n_docs, n_tokens), parts in order."""
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    by = ["doc_id", F.xxhash64("text")]  # rows of one id are dealt out as well
    ordered = columns.repartitionByRange(*by).sortWithinPartitions(*by)
    files = ordered.mapInArrow(_written(vocabulary or tokens.default_vocabulary(), end_id, scratch.path("files")), "part long, uri string, n_docs long, n_tokens long")
    return scratch.save(files, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = Reader(uri)
            sums, doc, at = np.zeros(file.n_docs, np.int64), 0, 0
            for ids in file.tokens(0, file.n):
                used = 0
                while used < len(ids):  # each document has its end id, so none is empty
                    take = min(int(file.starts[doc + 1]) - at, len(ids) - used)
                    sums[doc] = tokens.crc32(ids[used : used + take], int(sums[doc]))
                    used, at = used + take, at + take
                    doc += at == file.starts[doc + 1]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.ids, pa.int64(), mask=~file.valid), "start": before + file.starts[:-1], "n_tokens": np.diff(file.starts), "ids_crc32": sums})


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.select("uri", before.alias("before"))  # a row for each file
    spread = parts.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uri")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files of docs, then read every document back.

    A null or empty text is its end id alone; null ids come first and stay
    null; repeated ids stand side by side, each a document. An empty table
    makes no file and gives no rows; other columns are not read.
    """
    return read(write(docs, Scratch(docs.sparkSession, "tokens"), vocabulary, end_id=end_id))
