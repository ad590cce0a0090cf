import pytest

from kvern import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_agrees_with_its_sql(name, agree):
    agree(q.queries()[name], SQL[name])


def test_every_query_has_sql():
    assert set(SQL) == set(q.queries())
