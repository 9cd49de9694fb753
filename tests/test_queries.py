"""Every query of the library against its SQL on the same tables."""

import pytest

from tests.oracle import difference, tables
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert difference(df, catalog.ORACLES[name], con) == ""
    else:
        assert df.count() > 0
