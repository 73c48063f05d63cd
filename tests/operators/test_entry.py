import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_has_a_row_for_each_symbol(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert sorted(r.symbol for r in rows) == ["F", "O", "P"] and all(r.value is not None and r.rsi14 is not None for r in rows)
