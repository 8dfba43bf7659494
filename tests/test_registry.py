import __spark_entry__ as entry
from scoreloom import queries as registered


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(registered.QUERIES) <= set(queries)
    assert len(queries) > 110
