import pytest

from tessera.plans import catalog

from .oracle import check

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, name):
    check(spark, SMALL, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_query_without_oracle_has_rows(spark, name):
    assert not catalog.QUERIES[name](spark, SMALL).isEmpty()


def test_entry_runs_the_flagship(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
