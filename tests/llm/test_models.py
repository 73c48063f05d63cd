import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import langid, quality

SYLLABLES = {"en": "the ing on and er th".split(), "de": "sch ung der ein ü cht".split(), "fr": "eau é les ou que ment".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(n=300):
    rng = random.Random(2)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(5, 80)), lang, "s") for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, source string"


def test_languages(spark):
    rows = corpus() + [(900, None, "en", "s"), (901, "", None, "s"), (902, "12 34 !!", "de", "s"), (None, "the thing and the", "en", "s"), (5, "eau eau les", "fr", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = langid.identify(docs, langid.train(docs)).collect()
    assert len(out) == len(rows)
    right = [r._tm_lang == r.lang for r in out if r.doc_id is not None and r.doc_id < 900]
    assert np.mean(right) > 0.98
    assert {(r._tm_lang, r._tm_score, r._tm_rejected) for r in out if r.doc_id in (900, 901, 902)} == {("und", 0.0, True)}
    assert sum(r._tm_rejected for r in out) < 6 and all(0 <= r._tm_score <= 1 for r in out)


def test_far_texts_are_rejected(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rng = random.Random(3)
    odd = " ".join("".join(rng.choice("бвгджзклмнпрст") for _ in range(6)) for _ in range(120))
    assert langid.identify(spark.createDataFrame([(1, odd)], "doc_id long, text string"), langid.train(docs)).first()._tm_rejected


def test_noise_is_rejected_at_every_length(spark):
    rng = random.Random(13)
    model = langid.train(spark.createDataFrame(corpus(900), SCHEMA))
    clean = spark.createDataFrame([(i, t) for i, t, _, _ in corpus(300)], "doc_id long, text string")
    assert sum(r._tm_rejected for r in langid.identify(clean, model).collect()) <= 6
    for alphabet in ("bcdfghjklmnpqrstvwxzaeiou", "бвгджзклмнпрст", "".join(map(chr, range(0x3042, 0x3090)))):
        for n, least in ((3, 0.5), (10, 0.9), (50, 1), (200, 1)):
            noise = [(k, " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 9))) for _ in range(n))) for k in range(30)]
            found = langid.identify(spark.createDataFrame(noise, "doc_id long, text string"), model).collect()
            assert np.mean([r._tm_rejected for r in found]) >= least, (alphabet, n)


def test_dense_cosines(spark):
    """The prediction is that of the nearest centroid by plain dictionaries of n-grams."""
    docs = spark.createDataFrame(corpus(200), SCHEMA)
    model = langid.train(docs)
    for r in langid.identify(docs.limit(40), model).collect():
        data = re.sub(rb"[^a-z\x80-\xff]+", b" ", r.text.lower().encode())
        bag = {}
        for size in (2, 3):
            for k in range(len(data) - size + 1):
                code = int.from_bytes(bytes([0] * (3 - size)) + data[k : k + size], "big") | size << 8 * size
                place = (code * 2654435761 & 0xFFFFFFFF) >> 21
                bag[place] = bag.get(place, 0) + 1
        x = np.zeros(langid.DIMENSIONS)
        for place, n in bag.items():
            x[place] = np.log1p(n) * model.idf[place]
        near = model.centroids @ (x / np.linalg.norm(x))
        assert model.languages[model.owner[near.argmax()]] == r._tm_lang and abs(near.max() - r._tm_score) < 1e-4


def test_many_short_texts_and_a_long_one_are_counted_in_bounded_parts(monkeypatch):
    seen, counts = [], langid.counts
    monkeypatch.setattr(langid, "counts", lambda t: seen.append((len(t), sum(map(len, t.to_pylist())))) or counts(t))
    long = "the and of " * 1_000_000
    texts = pa.array(["short"] * 10_000 + [long], pa.large_string())
    got = np.concatenate([langid.all_counts(p) for p in langid.parts(texts, langid.ROWS)])
    assert max(n for n, _ in seen) <= langid.ROWS and max(b for _, b in seen) <= langid.PART_BYTES + 10
    assert abs(int(got[-1].sum()) - 2 * len(long)) < 30 and (got[:10_000] == got[0]).all()


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(7)
    for prior in (0.2, 0.5, 0.8):
        positive = rng.normal(1, 1, (2000, 6)).astype(np.float32)
        unlabelled = np.where(rng.random((4000, 1)) < prior, rng.normal(1, 1, (4000, 6)), rng.normal(-1, 1, (4000, 6))).astype(np.float32)
        assert abs(quality.estimate_prior(positive, unlabelled) - prior) < 0.1  # the margin of shares of 1000 and 2000 rows is 0.07
    assert quality.estimate_prior(positive[:2], unlabelled) == 1


def test_scores_from_plain_weights(spark):
    rows = corpus(400)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + rows[:30], SCHEMA)
    model = quality.train(docs, labels)
    for r in quality.score(docs, model).collect()[:60]:
        x = quality.features(pa.array([rows[r.doc_id][1]], pa.large_string()))[0]
        x = np.clip((x - model.mean) / model.scale, -6, 6)
        hidden = [max(0.0, float(sum(a * b for a, b in zip(x, w, strict=True)) + c)) for w, c in zip(model.w[0].T, model.w[1], strict=True)]
        assert abs(r.score - 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, model.w[2], strict=True)) + model.w[3][0])))) < 1e-5


def test_no_model_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.train(empty) is None and langid.identify(empty, None).collect() == []
    one = spark.createDataFrame([(1, "word", None, "s")], SCHEMA)
    assert [r._tm_lang for r in langid.identify(one, langid.train(one)).collect()] == ["und"] or langid.train(one) is None
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(empty, labels) is None
    assert [(r.score, r.predicted) for r in quality.score(one, None).collect()] == [(0.5, 1)]
    assert quality.score(empty, None).collect() == []


def test_counts_do_not_cross_texts():
    texts = ["ab", "", "cd ef", "É1é", "a" * 5000]
    whole = langid.counts(pa.array(texts, pa.large_string()))
    assert (whole == np.concatenate([langid.counts(pa.array([t], pa.large_string())) for t in texts])).all()
    parts = quality.features(pa.array(texts, pa.large_string()))
    assert np.allclose(parts, np.concatenate([quality.features(pa.array([t], pa.large_string())) for t in texts]))


def test_quality_separates_held_out_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i, t, lang, s in corpus(900):
        junk = rng.random() < 0.2
        rows.append((i, " ".join(w + rng.choice(["###", "&&&"]) for w in t.split()) if junk else t, lang, s))
        if i % 2:
            labels.append((i, int(not junk), 0))
    docs, marks = spark.createDataFrame([*rows, (2000, None, "en", "s"), (None, "", "en", "s")], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score(docs, quality.train(docs, marks)).collect()}
    assert len(out) == 902 and not out[None].held_out
    judged = [(out[i].predicted, q) for i, q, _ in labels if out[i].held_out]
    assert np.mean([p == q for p, q in judged]) > 0.95 and len({p for p, _ in judged}) == 2
