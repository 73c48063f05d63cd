import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, indicators
from tidemark.sources import providers
from tidemark.sources.cache import RangeCache

D = dt.date


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_price_csv_keeps_the_wall_date(spark, tmp_path):
    path = put(tmp_path, "p.csv", "Date,Open,High,Low,Close,Volume\n2020-04-20 00:00:00-04:00,18,19,-40,-37.63,5\n2020-04-21 00:00:00-04:00,1,2,3,x,6\n2020-04-21 00:00:00-04:00,1,2,3,4,7\n")
    assert [(r.date, r.close, r.volume) for r in providers.price_csv(spark, path).orderBy("date").collect()] == [(D(2020, 4, 20), -37.63, 5.0), (D(2020, 4, 21), 4.0, 7.0)]


def test_series_and_vintages(spark, tmp_path):
    path = put(tmp_path, "s.json", json.dumps({"response": {"total": 2, "data": [{"period": "2026-02", "value": "1.5", "units": "MBBL"}, {"period": "2026-03-06", "value": None, "units": "MBBL"}]}}))
    assert [(r.date, r.value, r.total) for r in providers.series_json(spark, path).collect()] == [(D(2026, 2, 28), 1.5, 2), (D(2026, 3, 6), None, 2)]
    with pytest.raises(Exception, match="payload has no response"):
        providers.series_json(spark, put(tmp_path, "bad.json", "{}")).collect()
    path = put(tmp_path, "v.json", json.dumps({"observations": [{"realtime_start": "2026-01-03", "date": "2026-01-02", "value": "."}]}))
    assert tuple(providers.vintages_json(spark, path).first()) == (D(2026, 1, 2), None, D(2026, 1, 3))
    path = put(tmp_path, "c.json", json.dumps([{"d": "2026-01-06T00:00:00", "a": "12", "b": ""}]))
    assert tuple(providers.positions_json(spark, path, "d", {"a": "long", "b": "short"}).first()) == (D(2026, 1, 6), 12.0, None)


def test_rss_and_headlines(spark, tmp_path):
    item = "<item><title>{}</title><link>u</link><pubDate>{}</pubDate>{}</item>"
    text = "<rss><channel>" + item.format("A", "Mon, 05 Jan 2026 10:00:00 GMT", "<source>S</source>") + item.format("B", "Tue, 06 Jan 2026 09:00:00 +0200", "") + item.format("C", "never", "") + "</channel></rss>"
    rows = providers.rss(spark, put(tmp_path, "r.xml", text), "feed")
    got = rows.select("title", "source", F.date_format("published", "yyyy-MM-dd HH:mm").alias("t")).collect()
    assert [tuple(r) for r in got] == [("B", "feed", "2026-01-06 07:00"), ("A", "S", "2026-01-05 10:00"), ("C", "feed", None)]
    both = rows.unionByName(rows.withColumn("feed", F.lit("other")))
    assert [(r.title, r.feed) for r in providers.headlines(both, F.lit("2026-01-01").cast("timestamp")).collect()] == [("B", "feed"), ("A", "feed")]


def test_json_lines(spark, tmp_path):
    path = put(tmp_path, "q.jsonl", '// note\n\n{"id": "a", "n": 1}\n  {"id": "b", "n": 2}\n')
    assert [tuple(r) for r in providers.lines_json(spark, path, "id string, n int").collect()] == [("a", 1), ("b", 2)]


def test_range_cache(spark, tmp_path):
    cache = RangeCache(spark, f"file://{tmp_path}/cache")
    assert cache.load("p", "CL=F") is None and cache.entries().count() == 0
    row = lambda d, v: (D(2026, 1, d), v)
    cache.refresh("p", "CL=F", spark.createDataFrame([row(1, 1.0), row(2, 2.0)], "date date, v double"))
    out = cache.refresh("p", "CL=F", spark.createDataFrame([row(2, 9.0), row(3, 3.0)], "date date, v double"))
    assert [(r.date.day, r.v) for r in out.orderBy("date").collect()] == [(1, 1.0), (2, 9.0), (3, 3.0)]
    cache.save("p", "a/b", spark.createDataFrame([(D(2026, 1, 1), 5.0, "x")], "date date, v double, more string"))
    assert tuple(cache.sql("SELECT count(*) AS n, max(v) AS m, count(more) AS k, count(DISTINCT filename) > 1 AS f FROM p").first()) == (4, 9.0, 1, True)
    assert sorted((r.key, r.n) for r in cache.entries().collect()) == [("CL=F", 3), ("a_b", 1)]


def test_features_do_not_look_ahead(spark):
    rows = [("x", D(2020, 1, 1) + dt.timedelta(k), 100.0 + (k * 7919) % 13, 120.0, 90.0, 100.0 + (k * 104729) % 17, 5.0 + k % 3) for k in range(300)]
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("ret", indicators.log_returns(F.col("close")))
    columns = ["cum_20", "vol_60", "dd_252", "range_pct_14", "volume_z20", "bb_pct_b"]
    cut = F.lit("2020-08-01").cast("date")
    assert features.leaks(features.price_features, bars, cut, columns).count() == 0
    planted = lambda b: features.price_features(b).withColumn("cum_20", F.lead("ret", 1).over(features.ordered()))
    assert {r["column"] for r in features.leaks(planted, bars, cut, columns).collect()} == {"cum_20"}
