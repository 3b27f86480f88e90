import pytest
from conftest import SF
from oracle import same

from wardlume import queries as library


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_matches_its_sql(spark, name):
    same(spark, SF, library.QUERIES[name], library.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert library.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
