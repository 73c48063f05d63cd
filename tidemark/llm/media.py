"""Media columns: Netpbm and BMP images in and out of numpy, tiles and difference hashes.

decode() reads P1 to P6 Netpbm files and uncompressed BMP files of 1, 4, 8, 24
and 32 bits; area_resize() averages source areas exactly, fractions of pixels
included, from an integral image; tile() stores an array as NPY bytes;
difference_hash() compares neighbours of a 9 x 8 reduction.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WIDTH = 64
TILE = 32
WHOLE = 1 << 22  # samples of an image that is integrated at once
BATCH_BYTES = 16 << 20  # images that are decoded before their rows are handed on
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A greyscale BMP of 8 bits: a palette of greys, rows from the bottom, each padded to 4 bytes."""
    height, width = pixels.shape
    rows = np.zeros((height, -(-width // 4) * 4), np.uint8)
    rows[:, :width] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    head = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", head + rows.size, 0, 0, head) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1:2], 2, []
    while len(fields) < 2 + (kind not in b"14"):
        found = _FIELD.match(data, at)
        if not found:
            raise ValueError("Netpbm header is cut short")
        fields.append(int(found[1]))
        at = found.end()
    width, height, most = (*fields, 1)[:3]
    if not 0 < most < 65536 or not width or not height:
        raise ValueError("Netpbm header is out of range")
    planes = 3 if kind in b"36" else 1
    n = width * height * planes
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([c - 48 for c in body if c in b"01"][:n] if kind == b"1" else [int(x) for x in body.split()[:n]], np.int64)
    elif kind == b"4":
        rows = np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1)
        values = np.unpackbits(rows, axis=1)[:, :width].astype(np.int64).ravel()
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(values) < n:
        raise ValueError("Netpbm samples are cut short")
    if kind in b"14":
        values = 1 - values  # 1 is black there
    if most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    out = values.astype(np.uint8).reshape(height, width, planes)
    return out[:, :, 0] if planes == 1 else out


def _bmp(data: bytes) -> np.ndarray:
    (start,), (head, width, height, _, bits, packed) = struct.unpack_from("<I", data, 10), struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("only uncompressed BMP of 1, 4, 8, 24 or 32 bits")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        out = rows[:, : width * bits // 8].reshape(len(rows), width, bits // 8)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
        index = rows if bits == 8 else np.packbits(np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits), axis=2, bitorder="big")[:, :, 0] >> 8 - bits
        out = palette[index[:, :width]]
    return np.ascontiguousarray(out[:, :, 0] if (out == out[:, :, :1]).all() else out)


def decode(data: bytes) -> np.ndarray:
    """The pixels of an image as height x width (grey) or height x width x 3 bytes; ValueError for anything else."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM" and len(data) >= 54:
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.linspace(0, n, parts + 1)
    whole = np.minimum(at.astype(np.int64), n - 1)
    return whole, at - whole


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from the integral image between whole pixels, as float64.

    An image of more than WHOLE samples has an integral image for each band of
    source rows that makes a row of the result, so it needs no more memory.
    """
    rows, down = _edges(pixels.shape[0], height)
    cols, across = _edges(pixels.shape[1], width)
    across = across.reshape(1, -1, *[1] * (pixels.ndim - 2))
    if pixels.size <= WHOLE:
        total = np.zeros((pixels.shape[0] + 1, *pixels.shape[1:]))
        total[1:] = pixels.cumsum(axis=0, dtype=np.float64)
        down = down.reshape(-1, *[1] * (pixels.ndim - 1))
        bands = np.diff(total[rows] * (1 - down) + total[rows + 1] * down, axis=0)
    else:
        bands = np.empty((height, *pixels.shape[1:]))
        for k, (first, last) in enumerate(zip(rows, rows[1:], strict=False)):
            bands[k] = pixels[first:last].sum(axis=0, dtype=np.int64) + down[k + 1] * pixels[last] - down[k] * pixels[first]
    total = np.zeros((height, pixels.shape[1] + 1, *pixels.shape[2:]))
    total[:, 1:] = bands.cumsum(axis=1)
    return np.diff(total[:, cols] * (1 - across) + total[:, cols + 1] * across, axis=1) / (pixels.shape[0] / height * pixels.shape[1] / width)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits, most significant first: whether each cell of a 9 x 8 reduction is darker than its right neighbour."""
    small = np.round(area_resize(grey(pixels), 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The image area-resized to side x side as NPY bytes."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(pixels, side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def text_image(text: bytes) -> bytes:
    """A text as the rows of a grey image 64 wide, zeros behind it; at least one row."""
    size = max(WIDTH, -(-len(text) // WIDTH) * WIDTH)
    return encode_pgm(np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, stop in _spans(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)):
            part = batch.slice(at, stop - at)
            texts = part.column(1).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([text_image(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most 256 rows and about BATCH_BYTES bytes; a larger one is a range of its own."""
    at = 0
    while at < len(sizes):
        stop, held = at + 1, int(sizes[at])
        while stop < len(sizes) and stop - at < 256 and held + sizes[stop] <= BATCH_BYTES:
            held, stop = held + int(sizes[stop]), stop + 1
        yield at, stop
        at = stop


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    for batch in batches:
        for at, stop in _spans(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)):
            part, rows = batch.slice(at, stop - at), []
            for media in part.column(2):
                media = media.as_py()
                pixels = decode(media)
                payload = pixels.reshape(-1)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(pixels):016x}", tile(pixels)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)


def store(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (doc_id, n_bytes, media) of the texts as images."""
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return scratch.save(columns.mapInArrow(_stored, "doc_id long, n_bytes long, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Digests, difference hash and NPY tile of each stored image, from its bytes alone."""
    return media.mapInArrow(_tiled, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def load_tile(tile: bytes) -> np.ndarray:
    return np.load(io.BytesIO(tile), allow_pickle=False)


def _read_tiles(tiles: pa.Array) -> pa.Array:
    return pa.array([float(load_tile(t.as_py()).mean()) for t in tiles], pa.float64())


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as an image, read the images back, describe them and store their tiles.

    The tiles (NPY bytes) are written as well and read back: tile_crc32 is that
    of the stored bytes and tile_mean the mean of the array that they load as.
    A null or empty text is one row of zeros. Rows are independent: repeated
    rows and ids give equal values, a null id stays null, an empty table gives
    no rows, and other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "media")
    tiles = scratch.save(describe(store(docs, scratch)), "tiles")
    scratch.drop("media")
    mean = F.arrow_udf(_read_tiles, "double")
    return tiles.withColumn("tile_crc32", F.crc32("tile")).withColumn("tile_mean", mean("tile"))
