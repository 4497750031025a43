import __spark_entry__


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "type", "score"] and found.count() == 30
