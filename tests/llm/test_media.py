import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media

RNG = np.random.default_rng(4)


def test_netpbm_kinds():
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4 9 1\n\xff\x00").tolist() == [[0] * 8 + [255]]
    assert media.decode(b"P2\n2 1\n15\n0 15\n").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6 1 1 255\n\x07\x08\x09").tolist() == [[[7, 8, 9]]]
    assert media.decode(b"P5 1 2 65535\n\xff\xff\x00\x00").tolist() == [[255], [0]]
    for bad in (b"", b"P", b"P5", b"P5 2 2 255\n\x00", b"GIF89a", b"BM", b"P5 0 1 255\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 70))
def test_grey_formats_round_trip(height, width):
    pixels = RNG.integers(0, 256, (height, width)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()


def test_bmp_of_24_bits_from_the_top():
    head = media.struct.pack("<2sIHHI", b"BM", 62, 0, 0, 54) + media.struct.pack("<IiiHHIIiiII", 40, 1, -2, 1, 24, 0, 8, 0, 0, 0, 0)
    assert media.decode(head + bytes([1, 2, 3, 0, 4, 5, 6, 0])).tolist() == [[[3, 2, 1]], [[6, 5, 4]]]


def brute_area(pixels, height, width):
    up = np.kron(pixels.astype(float), np.ones((height, width)))  # each pixel height x width times
    return up.reshape(height, pixels.shape[0], width, pixels.shape[1]).mean(axis=(1, 3))


def test_area_resize_is_the_mean_of_areas():
    for shape in ((1, 64), (7, 5), (64, 64), (3, 64)):
        pixels = RNG.integers(0, 256, shape)
        for size in ((8, 9), (32, 32), (1, 1)):
            assert np.allclose(media.area_resize(pixels, *size), brute_area(pixels, *size))


def test_tall_images_are_resized_band_by_band(monkeypatch):
    shapes = [RNG.integers(0, 256, s) for s in ((1, 64), (5, 64), (4097, 64), (37, 11, 3))]
    whole = [media.area_resize(x, *size) for x in shapes for size in ((8, 9), (32, 32))]
    monkeypatch.setattr(media, "WHOLE", 0)
    assert all(np.allclose(a, b) for a, b in zip(whole, [media.area_resize(x, *size) for x in shapes for size in ((8, 9), (32, 32))], strict=True))


def test_tiles_are_stored_and_read_back(spark):
    rows = media.text_media(spark.createDataFrame([(1, "abc" * 100), (2, None)], "doc_id long, text string")).collect()
    for r in rows:
        assert r.tile_crc32 == zlib.crc32(bytes(r.tile)) and r.tile_mean == media.load_tile(bytes(r.tile)).mean()


def test_queries_columns(spark):
    texts = ["", None, "a" * 64, "b" * 65, "ü" * 1000, "x", "x", "long " * 50_000]
    rows = {r.doc_id: r for r in media.text_media(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert np.load(io.BytesIO(bytes(r.tile))).shape == (32, 32)
    assert rows[5][1:] == rows[6][1:]
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).collect() == []
