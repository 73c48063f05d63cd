"""Token ids of whole texts, one library call for each new part of a word.

Where a vocabulary drops white space and never joins across it, the ids of a
text are those of its words (runs without ASCII white space) one after the
other; a probe text tells when the vocabulary is loaded, and others encode
whole texts. Arrow finds the distinct words of a batch, and cuts those of
letters and closing punctuation in two; only parts that a worker has not met
lately are encoded.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHED_PIECES = 300_000  # parts of words kept between batches: about 45 bytes each
CACHED_BYTES = 24 << 20
LONG = 64  # bytes of a part that is not kept once there are too many
#: What the shortcuts must encode as the library does; a vocabulary for which they do not is used text by text.
PROBE = "  The quick (brown) foxes, don't  JUMP\tover\nüber Größe, naïve 'til 12 345.67% a_b e-mail@x.org ---\r\n\u4f60\u597d \ufb01n x\u0301y  "
#: ASCII punctuation that cannot begin a contraction or a special token.
PUNCTUATION = '!"#$%&()*+,-./:;=>?@[\\]^_`{|}~'
#: The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_INS = {b: b if b in _PRINTED else 256 + k for k, b in enumerate([b for b in range(256) if b not in _PRINTED])} | {b: b for b in _PRINTED}
#: Letters below U+0250 of either case that the library's normaliser lower-cases one by one, as Arrow does, and else leaves as they are.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250")
BATCH_BYTES = 4 << 20
SPACE = b" \t\n\r\x0b\x0c"


def default_vocabulary() -> str:
    """The path of the word vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(flat: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that codes name, end to end, and where each starts (with the end of the last)."""
    counts = np.diff(starts)[codes]
    ends = np.r_[0, np.cumsum(counts)]
    at = np.repeat(starts[codes] - ends[:-1], counts)
    at += np.arange(ends[-1])
    return flat[at], ends


class WordEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.ids, self.starts = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.used, self.batch = np.empty(0, np.int64), 0  # the batch that last needed each piece
        self.model = self.tokenizer.model
        texts = pa.array([PROBE, *PROBE.split(" ")], pa.large_string())
        ids, starts = self.by_words(texts)
        whole = self.encoded(texts.to_pylist())
        self.exact = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)] == whole

    def stem(self, word: str) -> bytes:
        """The ids of a lower-case word of LETTERS, which the library's normaliser leaves as it is and its splitter whole."""
        units = word if word.isascii() else word.encode().decode("latin-1").translate(STAND_INS)
        return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces is kept; those that are new are encoded and join."""
        self.batch += 1
        if len(self.pieces) > CACHED_PIECES or self.pieces.nbytes + self.ids.nbytes > CACHED_BYTES:
            self.forget()
        found = pc.index_in(pieces, value_set=self.pieces)
        missing = found.is_null()
        new = pieces.filter(missing)
        plain = pc.binary_length(pc.utf8_ltrim(new, characters=LETTERS)).to_numpy() == 0
        words = new.to_pylist()
        out = [self.stem(w) if p else b"" for w, p in zip(words, plain.tolist(), strict=True)]
        others = np.flatnonzero(~plain).tolist()
        for k, ids in zip(others, self.encoded([words[k] for k in others]), strict=True):
            out[k] = ids
        places = found.fill_null(0).to_numpy().astype(np.int64)
        places[missing.to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(new))
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) // 4)]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(out), "<u4")])
        self.used = np.r_[self.used, np.zeros(len(new), np.int64)]
        self.used[places] = self.batch
        return places

    def forget(self) -> None:
        """Keep half of CACHED_PIECES, those that were needed last, without long ones."""
        short = np.flatnonzero(pc.binary_length(self.pieces).to_numpy() <= LONG)
        kept = np.sort(short[np.argsort(-self.used[short], kind="stable")[: CACHED_PIECES // 2]])
        self.ids, self.starts = gather(self.ids, self.starts, kept)
        self.pieces, self.used = self.pieces.take(pa.array(kept)), self.used[kept]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and where each word starts (with the end of the last)."""
        stem, tail = pc.utf8_rtrim(words, characters=PUNCTUATION), pc.utf8_ltrim(words, characters=LETTERS)
        long = pc.binary_length(stem)
        cut = pc.and_(pc.greater(long, 0), pc.equal(pc.add(long, pc.binary_length(tail)), pc.binary_length(words)))  # letters, then punctuation
        pieces = pa.concat_arrays([pc.if_else(cut, pc.utf8_lower(stem), words), pc.if_else(cut, tail, "")]).dictionary_encode()
        codes = self.places(pieces.dictionary)[pieces.indices.to_numpy()]
        ids, starts = gather(self.ids, self.starts, codes.reshape(2, -1).T.ravel())
        return ids, starts[::2]

    def encoded(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for at in range(0, len(words), 20_000) for e in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text starts (with the end of the last)."""
        if self.exact:
            return self.by_words(texts)
        found = self.encoded(texts.to_pylist())
        return np.frombuffer(b"".join(found), "<u4"), np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int64)

    def by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        ids, starts = gather(*self.words(flat.dictionary), flat.indices.to_numpy())
        return ids, starts[split.offsets.to_numpy() - split.offsets[0].as_py()]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(text: bytes) -> list[bytes]:
    """A very long text cut at white space."""
    out, at = [], 0
    while len(text) - at > BATCH_BYTES:
        end = min((k for s in SPACE if (k := text.find(s, at + BATCH_BYTES)) >= 0), default=len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode(column: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text of a string column, with end_id after them; a null text is empty."""
    column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    words, at = encoder(path), 0
    while at < len(column):
        stop, size = at + 1, sizes[at]
        while stop < len(column) and size + sizes[stop] <= BATCH_BYTES:
            size += sizes[stop]
            stop += 1
        if size > BATCH_BYTES and words.exact:
            parts = _pieces(column[at].as_py().encode())
            ids = [words.texts(pa.array([p.decode()], pa.large_string()))[0] for p in parts]
            yield np.concatenate([*ids, np.array([end_id], "<u4")])
        else:
            ids, starts = words.texts(column.slice(at, stop - at))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield np.append(ids[a:b], np.uint32(end_id))
        at = stop


def crc32(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"), before)
