"""Queries with SQL against DuckDB on the same tables."""

import pytest
from compare import duck, duck_rows, kinds, spark_rows

from tallymark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    con = duck(sf)
    df = QUERIES[name](spark, sf)
    columns, theirs = duck_rows(con, ORACLES[name])
    assert sorted(columns) == sorted(df.columns)
    ours, other = kinds(df, con, ORACLES[name])
    assert ours == other
    assert spark_rows(df) == theirs
