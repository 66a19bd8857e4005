import __spark_entry__


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 40


def test_entry_runs(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["category", "n", "ratio"] and found.count() >= 0
