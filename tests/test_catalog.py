import pytest
from compare import duck_rows, spark_rows

from tallyloom.plans import archive_queries, catalog, contract_queries, market_queries, projection_queries, scan_queries  # noqa: F401
from tallyloom.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    if name in SQL:
        assert (columns, rows) == duck_rows(FOLDER, SQL[name])
    else:
        assert rows


def test_sql_is_for_queries():
    assert set(SQL) <= set(QUERIES)
