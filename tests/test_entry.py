import __spark_entry__ as e


def test_queries_and_sql_are_registered():
    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 50


def test_flagship(spark):
    got = e.entry(spark)
    assert got.columns == ["rank", "id", "title", "starts_at", "distance_cm", "venue", "region"] and got.count() > 0
