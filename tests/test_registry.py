import __spark_entry__ as entrypoint


def test_every_sql_has_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_entry_runs(spark):
    assert entrypoint.entry(spark).count() > 0
