"""Queries that are registered over a whole table give a row for each of its rows."""

import pytest

from tessera import queries as relational

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table"), [("project_expr", "lineitem"), ("fn_arith_real", "lineitem")])
def test_every_row_is_there(spark, name, table):
    assert relational.queries()[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert "WHERE" not in relational.oracle_sql()[name].upper()
