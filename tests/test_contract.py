import __spark_entry__ as entry


def test_queries_and_sql_agree_in_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 35


def test_entry(spark):
    assert entry.entry(spark).count() > 0
