import pytest
from oracle import connect, differs

from sedge.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert differs(spark, con, registry.queries()[name], registry.oracle_sql()[name], FOLDER) is None
