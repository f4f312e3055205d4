import pytest
from oracle import connect, differs

from sedge.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differs(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_gives_a_row_for_each_row(spark, name):
    table = "pages" if name.startswith("op10") else "documents"
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
