import random

import duckdb

import __spark_entry__
from tidemark.operators import evaluate

SF = "/root/testdata/sf0.001"


def greedy(positions, by):
    out = []
    for p in sorted(positions):
        if not out or p - out[-1] >= by:
            out.append(p)
    return out


def test_irregular_groups_across_batches(spark):
    rng = random.Random(4)
    groups = {"a": [rng.randrange(200_000) for _ in range(40_000)], "b": [0, 19, 20, 39, 41, 200, 200, 219], None: [5, -30, 4], "c": [7]}
    rows = [(g, p) for g, ps in groups.items() for p in ps] + [("d", None)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = evaluate.spaced(spark.createDataFrame(rows, "model string, pos long"), ["model"], 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {g: sorted(r.pos for r in got if r.model == g) for g in groups} == {g: greedy(ps, 20) for g, ps in groups.items()}
    assert len(got) == sum(len(greedy(ps, 20)) for ps in groups.values())


def test_every_event_counts(spark):
    name, by = "non_overlapping_events", 3_600_000_000
    got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, SF).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert got == sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())
    times = {}
    for user, pos in con.sql("SELECT user_id, epoch_us(ts) FROM events").fetchall():
        times.setdefault(user, []).append(pos)
    assert got == sorted((u, p) for u, ps in times.items() for p in greedy(ps, by))
    assert len({b - a for (u, a), (v, b) in zip(got, got[1:]) if u == v}) > 100
