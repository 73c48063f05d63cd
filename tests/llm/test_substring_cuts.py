import random

import numpy as np
import pyarrow as pa

from tidemark.llm import substring

SCHEMA = "doc_id long, text string"
WORDS = ["w" + "".join(random.Random(k).choice("abcdefgh") for _ in range(5)) + str(k) for k in range(4000)]


def left(spark, texts):
    return {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}


def shared_words(a, b):
    """The most words of a run that both texts hold."""
    found = substring.units(pa.array([a, b], pa.large_string()))
    first, stop = substring.runs(found)
    h = list(zip(*(x.tolist() for x in found.hashes(first, stop)), strict=True))
    one = {x for x, f in zip(h, first, strict=True) if found.doc[f] == 0}
    return max((found.word[s] - found.word[f] for x, f, s in zip(h, first, stop, strict=True) if found.doc[f] and x in one), default=0)


def test_every_passage_of_51_words_holds_a_run():
    rng = random.Random(21)
    for k in range(1500):
        stops = rng.choice([0, 0, 0.03, 0.07, 0.15])
        words = lambda n: " ".join(rng.choice(WORDS) + ("." if rng.random() < stops else "") for _ in range(n))  # noqa: B023, E731
        passage = words(51)
        a, b = (f"{words(rng.randrange(40))} {passage} {words(rng.randrange(40))}" for _ in range(2))
        assert shared_words(a, b), (k, passage)


def test_a_long_sentence_inside_other_text(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = words(120)
    out = left(spark, [f"{words(30)} {shared} {words(30)}" for _ in range(4)])
    assert out[0].words_removed == 0 and all(95 < out[i].words_removed <= 120 for i in (1, 2, 3))


def test_texts_without_spaces(spark):
    rng = random.Random(22)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) + ("。" if rng.random() < 0.05 else "") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for make, size in ((han, 60), (letters, 600)):
        shared = make(size)
        texts = [make(100) + shared + make(100) for _ in range(3)]
        got = left(spark, texts)
        assert got[0].n_removed == 0 and all(size * 0.5 < len(texts[i]) - len(got[i].text) <= size * 1.1 for i in (1, 2))
    assert np.cumsum(substring.pieces(texts[0]))[-1] == len(texts[0])
