from collections import defaultdict

from tidemark.llm.exact import exact_dedup

SCHEMA = "doc_id long, text string"


def check(spark, rows):
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""])) for i, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(max(g) for g in groups.values())


def test_matches_grouping_by_text(spark):
    long = "word " * 60_000
    texts = [long, long, long + "a", long + "b", long[:-1] + "x", None, "", "", " ", "a", "a", "b", "é", "é", "\x00", "\x00\x00"]
    texts += ["x" * n for n in (31, 32, 33, 287, 288, 289)] * 2 + ["x" * 288 + c for c in "aab"]
    check(spark, list(enumerate(texts)))


def test_repeated_rows_keep_one(spark):
    check(spark, [(7, "same"), (7, "same"), (3, "same"), (7, "other"), (7, "other")])


def test_empty_table_and_text_carried(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, "t", "k", 4), (2, "t", None, 5), (3, None, "q", 6)], SCHEMA + ", count string, n int")
    got = sorted(exact_dedup(rows, with_text=True).filter("kept").select("doc_id", "text", "count", "n").collect())
    assert [tuple(r) for r in got] == [(2, "t", None, 5), (3, None, "q", 6)]
