import pytest

from pointloom import queries as q
from tests.oracle import SF, same

ORACLES = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same(spark, q.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
