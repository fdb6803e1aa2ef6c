import __spark_entry__


def test_names_and_oracles():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and "q_groupby_sum" in queries


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
