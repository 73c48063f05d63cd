"""Each stage of the pipeline against brute force over what the one before kept."""

import random
from collections import Counter

import pytest
from test_mixing import brute as mixed
from test_models import SYLLABLES, text
from test_similar import brute_least

import corpus_pipeline
from tidemark.llm import tokens


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(12)
    rows = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text(rng, lang, rng.randrange(30, 120)), lang, f"src{min(i % 9, 3)}", 0))
    for k in range(12):  # copies, and copies with one word changed
        words = rows[k][1].split()
        rows.append((200 + k, rows[k][1], rows[k][2], "src1", 0))
        rows.append((300 + k, " ".join(["qq", *words[1:]]), rows[k][2], "src2", 0))
    return [*rows, (500, None, "en", "src0", 0), (501, "1234 !!", "en", "src0", 0), (502, rows[0][1], "en", None, 0)]


def test_stages(spark, tmp_path, documents):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents, schema).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    first = {r.doc_id: r.text for r in seen["language"]}
    assert not {500, 501} & set(first) and len(first) >= len(documents) - 4
    last = {}
    for i, t in sorted(first.items()):
        last[t] = i
    assert {r.doc_id: r.text for r in seen["exact_copies"]} == {i: t for t, i in last.items()}
    least = brute_least(sorted((i, t) for t, i in last.items()))
    assert len(set(least.values())) == len(least) - 12
    assert sorted(r.doc_id for r in seen["near_copies"]) == sorted(set(least.values()))

    rows = [(r.doc_id, r.text, r.source) for r in seen["near_copies"]]
    taken = Counter(r.doc_id for r in seen["mixture"])
    for doc_id, size, _, _, words in mixed(rows):
        assert abs(taken[doc_id] * size - words) <= size / 2 + 1e-9

    library = tokens.encoder(tokens.default_vocabulary()).tokenizer
    want = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["mixture"])
    assert sum(r.length for r in seen["sequences"]) == want
    assert Counter(r.doc_id for r in seen["sequences"] if r.start == 0) == taken


def test_run_gives_the_last_stage(spark, tmp_path, documents):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_with_clashing_columns_and_no_rows(spark, documents):
    names = "kept keep_id size position passes target row others _tm_lang fp gone".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    for rows in ([(*r, *range(len(names))) for r in documents], []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "").persist()
            assert (out.count() > 0) == bool(rows)
            if name == "sequences":
                break
            assert out.columns == docs.columns
            assert all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect())
            docs = out


def test_near_copies_with_null_and_repeated_ids(spark):
    t, u = (" ".join(f"{c}{k}" for k in range(60)) for c in "tu")
    rows = [(1, t), (None, t), (None, u), (None, u), (5, "alone here"), (5, "another text of id five"), (5, "alone here"), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([(1, t), (None, u), (5, "alone here"), (5, "another text of id five"), (9, "")], key=str)
