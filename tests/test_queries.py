"""Every registered query of the domain's own operators against its SQL."""

import pytest

from ballast.plans import registry
from tests.oracle import database, differs


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert differs(df, con, sql) is None
