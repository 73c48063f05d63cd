"""Content keys, stored results, vintages of news and SQL functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import content, registry
from tidemark.sources import news, results, written

D, T = dt.date, dt.datetime
ROWS = "k string, x double, d date, a array<int>"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_keys_follow_contents_only(spark):
    rows = [("a", 1.5, D(2026, 1, 1), [1, None]), ("b", None, None, None), (None, 2.0, D(2026, 1, 2), []), ("b", None, None, None)]
    base = content.content_key({"t": table(spark, rows)}, {"n": 1})
    assert base == content.content_key({"t": table(spark, rows[::-1]).repartition(3).select("d", "a", "k", "x")}, {"n": 1})
    others = [rows[:3], [*rows, rows[0]], [("a", 1.5, D(2026, 1, 1), [None, 1]), *rows[1:]], [*rows[:2], ("", 2.0, D(2026, 1, 2), []), rows[3]], [(None, 1.5, D(2026, 1, 1), [1, None]), *rows[1:2], ("a", 2.0, D(2026, 1, 2), []), rows[3]]]
    keys = [content.content_key({"t": table(spark, r)}, {"n": 1}) for r in others]
    keys += [content.content_key({"t": table(spark, rows)}, {"n": 2}), content.content_key({"u": table(spark, rows)}, {"n": 1}), content.content_key({"t": table(spark, rows).withColumnRenamed("x", "y")}, {"n": 1})]
    assert len({base, *keys}) == len(keys) + 1
    by = content.content_of(table(spark, rows), "k").collect()
    assert {r.k: r.n for r in by} == {"a": 1, "b": 2, None: 1} and all(len(r.content) == 32 for r in by)
    assert content.content_of(table(spark, [])).first().n == 0


def test_results_are_computed_once(spark, tmp_path):
    rows, calls = table(spark, [("a", 1.0, None, None)]), []

    def compute():
        calls.append(1)
        return rows.groupBy("k").count()

    ask = lambda frame=rows, config=1, refresh=False: results.cached(spark, f"file://{tmp_path}", "board", {"rows": frame}, config, compute, refresh).collect()
    assert ask() == ask() and len(calls) == 1
    ask(config=2), ask(rows.withColumn("x", F.lit(2.0))), ask(refresh=True)
    assert len(calls) == 4
    (next(p for p in (tmp_path / "board").iterdir() if p.is_dir()) / "_SUCCESS").unlink()  # half a result counts as none
    [ask(), ask(config=2), ask(rows.withColumn("x", F.lit(2.0)))]
    assert len(calls) == 5


def test_vintages_of_news(spark):
    at = lambda h, d=5: T(2026, 1, d, h)
    batch = lambda *rows: spark.createDataFrame(rows, news.ITEM)
    first = batch(("f", "A", "u1", at(1), "s"), ("f", "B", "u2", at(2), "s"), ("f", "B", "u9", at(1), "s"), ("f", None, "x", at(1), "s"))
    one = news.merged(news.empty(spark), first, F.lit(at(3)))
    again = news.merged(one, first, F.lit(at(4)))
    key = lambda frame: sorted(map(tuple, frame.collect()))
    assert key(one) == key(again) == [("f", "A", "u1", at(1), "s", at(3), 0), ("f", "B", "u2", at(2), "s", at(3), 0)]
    second = batch(("f", "A", "u1b", at(1), "s"), ("g", "A", "u7", at(5), "s"), ("g", "C", "u8", at(6), "s"))
    two = news.merged(again, second, F.lit(at(7)))
    assert key(two) == key(news.merged(two, second, F.lit(at(9)))) and ("f", "A", "u1b", at(1), "s", at(3), 1) in key(two)
    assert [(r.title, r.feed) for r in news.headlines(two, F.lit(at(8))).collect()] == [("C", "g"), ("B", "f"), ("A", "f")]
    assert [r.title for r in news.headlines(two, F.lit(at(4))).collect()] == ["B", "A"] and news.headlines(two, F.lit(at(8, 30))).count() == 0
    assert {r.feed: (r.age_hours, r.stale) for r in news.stale(two, F.lit(at(9)), 2.5).collect()} == {"f": (6.0, True), "g": (2.0, False)}


def test_functions_in_sql(spark):
    assert len(registry.register(spark)) == 8
    row = spark.sql("SELECT folded_week(DATE'2026-12-31') AS w, weekdays_between(DATE'2026-01-02', DATE'2026-01-06') AS n, pinball(1.0D, 0.0D, 0.9D) AS p, log_return(0.0D, 1.0D) AS r, written_decimals(1.25D) AS d, written_decimals(3.0D) AS z").first()
    assert (row.w, row.n, row.p, row.r, row.d, row.z) == (52, 2, 0.9, None, 2, 0)
    spark.createDataFrame([(1, "One. Two!\nThree"), (2, ""), (3, None)], "id int, body string").createOrReplaceTempView("notes_")
    got = spark.sql("SELECT id, s.sentence FROM notes_, LATERAL sentences_of(body) AS s ORDER BY id, at").collect()
    assert [tuple(r) for r in got] == [(1, "One."), (1, "Two!"), (1, "Three")]
    assert spark.sql("SELECT sum(days) FROM business_weeks(DATE'2026-01-01', DATE'2026-01-31')").first()[0] == 22
    spark.createDataFrame([("a", p) for p in (0, 3, 5, 9, 10, 15)] + [("b", 7), ("b", None), ("b", 8)], "k string, pos int").repartition(4).createOrReplaceTempView("places_")
    kept = spark.sql("SELECT k, pos, kept FROM spaced(TABLE(SELECT * FROM places_) PARTITION BY k ORDER BY (pos), 'pos', 5)").collect()
    assert sorted(map(tuple, kept)) == [("a", 0, 1), ("a", 5, 2), ("a", 10, 3), ("a", 15, 4), ("b", 7, 1)]
    with pytest.raises(Exception, match="needs a table"):
        spark.sql("SELECT * FROM spaced(TABLE(SELECT * FROM places_) PARTITION BY k ORDER BY (pos), 'nope', 5)").collect()


def test_written_tables_can_be_cleared(spark):
    mine = written.Written(spark, "clearing")
    mine.save(spark.range(3), "t")
    mine.save(spark.range(3), "u")
    mine.drop("u")
    assert any(mine.root.rsplit("/", 1)[1] in p for p in written.leftovers(spark)) and not any(mine.root.rsplit("/", 1)[1] in p for p in written.leftovers(spark, 3600))
    assert written.clear(spark, 1e9) == []
