import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["query_id", "doc_id", "score", "rank"] and got.count() == 400
