"""Range arithmetic by days, the commits of the cache, and the paged source."""

import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import paged, ranges
from tidemark.sources.cache import Conflict, DataUnavailable, RangeCache

D = dt.date
KEYED = "key string, first date, last date"


def days(rows, key):
    return {a + dt.timedelta(k) for n, a, b in rows if n == key and a and b for k in range((b - a).days + 1)}


def test_ranges_by_days(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice("abc"), a := D(2026, 1, 1) + dt.timedelta(rng.randrange(60)), a + dt.timedelta(rng.randrange(-2, 9))) for _ in range(n)]
    for _ in range(3):
        wanted, held = [*some(8), ("d", D(2026, 1, 5), D(2026, 1, 9)), ("d", None, D(2026, 1, 9))], some(14)
        w, h = spark.createDataFrame(wanted, KEYED), spark.createDataFrame(held, KEYED)
        one, gaps = [tuple(r) for r in ranges.merged(h, ["key"]).collect()], [tuple(r) for r in ranges.missing(w, h, ["key"]).collect()]
        for key in "abcd":
            assert days(one, key) == days(held, key) and days(gaps, key) == days(wanted, key) - days(held, key)
            own = sorted(r[1:] for r in one if r[0] == key)
            assert all(b + dt.timedelta(1) < c for (_, b), (c, _) in zip(own, own[1:], strict=False))


def test_what_is_fetched(spark):
    now, d = dt.datetime(2026, 3, 1, 12), lambda k: D(2026, 2, k)
    requests = [("new", d(1), d(10), False), ("fresh", d(1), d(10), False), ("head", D(2026, 1, 1), d(10), False), ("stale", d(3), d(28), False), ("old end", d(1), d(5), False), ("empty", d(1), d(10), False), ("again", d(1), d(10), True), ("both", D(2026, 1, 1), d(28), False)]
    asked = spark.createDataFrame([("p", k, a, b, now, 24.0, r) for k, a, b, r in requests], "provider string, key string, start date, end date, now timestamp, ttl_hours double, refresh boolean")
    young, aged = now - dt.timedelta(hours=24), now - dt.timedelta(hours=24, seconds=1)
    rows = [("fresh", d(1), d(10), young), ("head", d(1), d(10), young), ("stale", d(1), d(20), aged), ("old end", d(1), d(10), aged), ("empty", d(1), None, aged), ("again", d(1), d(10), young), ("both", d(1), d(20), aged)]
    coverage = spark.createDataFrame([("p", *r) for r in rows], "provider string, key string, coverage_start date, last_row date, fetched_at timestamp")
    got = {r.key: (r.source, [tuple(p) for p in r.parts]) for r in ranges.to_fetch(asked, coverage).collect()}
    assert got == {
        "new": ("network", [("all", d(1), d(10))]), "fresh": ("cache", []), "head": ("cache+network", [("head", D(2026, 1, 1), D(2026, 1, 31))]), "stale": ("cache+network", [("tail", d(13), d(28))]),
        "old end": ("cache", []), "empty": ("cache+network", [("tail", d(1), d(10))]), "again": ("network", [("all", d(1), d(10))]), "both": ("cache+network", [("head", D(2026, 1, 1), D(2026, 1, 31)), ("tail", d(13), d(28))]),
    }


def series(spark, first, last, value=1.0):
    return spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"), F.lit(value).alias("v"))


def test_ranged_reads_and_fetches(spark, tmp_path):
    cache, calls = RangeCache(spark, f"file://{tmp_path}/c"), []

    def fetch(key, first, last):
        calls.append((first, last))
        return series(spark, first, last, float(len(calls)))

    t = dt.datetime(2026, 3, 1)
    with pytest.raises(DataUnavailable):
        cache.ranged("p", "k", D(2026, 2, 1), D(2026, 2, 9), 24, None, t)
    assert cache.ranged("p", "k", D(2026, 2, 1), D(2026, 2, 9), 24, fetch, t).count() == 9
    assert cache.ranged("p", "k", D(2026, 2, 3), D(2026, 2, 5), 24, fetch, t).count() == 3
    assert cache.ranged("p", "k", D(2026, 1, 30), D(2026, 2, 5), 24, fetch, t).count() == 7
    late = cache.ranged("p", "k", D(2026, 2, 1), D(2026, 2, 20), 24, fetch, t + dt.timedelta(days=2))
    assert calls == [(D(2026, 2, 1), D(2026, 2, 9)), (D(2026, 1, 30), D(2026, 1, 31)), (D(2026, 2, 2), D(2026, 2, 20))]
    assert {r.date.day: r.v for r in late.collect()} == {1: 1.0} | {k: 3.0 for k in range(2, 21)}
    with pytest.raises(DataUnavailable):
        cache.ranged("p", "none", D(2026, 2, 1), D(2026, 2, 9), 24, lambda *_: series(spark, D(2026, 2, 2), D(2026, 2, 1)), t)


def test_one_of_two_writers_wins(spark, tmp_path):
    cache = RangeCache(spark, f"file://{tmp_path}/c")
    seen = cache.version()
    row = series(spark, D(2026, 1, 1), D(2026, 1, 2))
    assert cache.save("p", "a", row, seen=seen) == 1
    with pytest.raises(Conflict):
        cache.save("p", "a", row, seen=seen)
    assert cache.save("p", "b", row, seen=seen) == 2  # another series: behind it
    t = dt.datetime(2026, 3, 1)
    both = threading.Barrier(2, timeout=60)

    def writer(first, value):
        waited = []

        def fetch(key, a, b):
            if not waited:
                waited.append(both.wait())
            return series(spark, a, b, value)

        RangeCache(spark, f"file://{tmp_path}/c").ranged("p", "z", first, D(2026, 1, 9), 24, fetch, t)

    threads = [threading.Thread(target=writer, args=x) for x in ((D(2026, 1, 1), 1.0), (D(2026, 1, 5), 2.0))]
    [x.start() for x in threads], [x.join() for x in threads]
    assert cache.load("p", "z").count() == 9 and cache.entry("p", "z").coverage_start == D(2026, 1, 1)


def put_pages(root, key, rows, size, total=None):
    (root / key).mkdir(parents=True)
    for k in range(0, max(len(rows), 1), size):
        body = {"response": {"total": len(rows) if total is None else total, "data": rows[k : k + size]}}
        (root / key / f"page-{k // size:04d}.json").write_text(json.dumps(body))


def test_paged_source(spark, tmp_path):
    rows = [{"period": str(D(2026, 1, 2) + dt.timedelta(7 * k)), "value": str(k) if k != 3 else "x", "units": "MBBL"} for k in range(10)]
    put_pages(tmp_path / "ok", "W1", rows, 4)
    put_pages(tmp_path / "ok", "W2", [{"period": "2026-02", "value": 1}, {"period": "2025", "value": None}], 5)
    spark.dataSource.register(paged.PagedSeries)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("paged_series").load(f"file://{tmp_path}/ok")
    assert source.count() == 12 and source.rdd.getNumPartitions() == 4
    assert sorted((r.key, r.date, r.value) for r in source.filter("page = 0 and key = 'W2'").collect()) == [("W2", D(2025, 12, 31), None), ("W2", D(2026, 2, 28), 1.0)]
    part = source.filter("key = 'W1' and date > '2026-01-16' and date <= '2026-02-06'")
    assert sorted((r.date, r.value) for r in part.collect()) == [(D(2026, 1, 23), None), (D(2026, 1, 30), 4.0), (D(2026, 2, 6), 5.0)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and part.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("broken", ["short", "gone", "more"])
def test_pages_must_add_up(spark, tmp_path, broken):
    rows = [{"period": "2026-01-02", "value": k} for k in range(10)]
    put_pages(tmp_path, "W1", rows, 4)
    page = tmp_path / "W1" / "page-0001.json"
    if broken == "short":
        body = json.loads(page.read_text())
        body["response"]["data"].pop()
        page.write_text(json.dumps(body))
    elif broken == "gone":
        page.unlink()
    else:
        (tmp_path / "W1" / "page-0003.json").write_text(page.read_text())
    spark.dataSource.register(paged.PagedSeries)
    with pytest.raises(Exception, match="W1"):
        spark.read.format("paged_series").load(f"file://{tmp_path}").collect()
