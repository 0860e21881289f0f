"""Every registered query against its SQL on the small tables, and the shape of its plan."""

import pytest
from compare import duck, duck_rows, kinds, spark_rows

from tallymark.plans import load_catalog

CATALOG = load_catalog()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, sf, con, name):
    entry = CATALOG[name]
    df = entry.run(spark, sf)
    ours = spark_rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if entry.oracle is None:
        assert ours
        return
    columns, theirs = duck_rows(con, entry.oracle)
    assert sorted(columns) == sorted(df.columns)
    spark_kinds, duck_kinds = kinds(df, con, entry.oracle)
    assert spark_kinds == duck_kinds
    assert ours == theirs


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
