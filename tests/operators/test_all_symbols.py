import __spark_entry__
from tidemark.operators import forecast
from tidemark.plans import series

SF = "/root/testdata/sf0.01"


def test_walk_forward_covers_every_symbol(spark):
    rows = __spark_entry__.queries()["walk_forward_leaderboard"](spark, SF).collect()
    counts = {r.symbol: r["count"] for r in series.day_bars(spark, SF).groupBy("symbol").count().collect()}
    assert {r.symbol for r in rows} == {s for s, n in counts.items() if n > 1000} and len({r.symbol for r in rows}) > 1
    one = series.all_series(spark, SF).filter("symbol = 'O'")
    alone = sorted((r.model, r.n) for r in forecast.walk_forward(one, 5).collect())
    assert sorted((r.model, r.n) for r in rows if r.symbol == "O") == alone
