import pytest

from lodestone.plans import registry

from .compare import assert_same, connect

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
