"""Every query that has SQL gives the SQL's rows; every query runs, with columns that don't depend on the data."""

import pytest

from stemmata.plans.queries import QUERIES, SQL

SLOW = {"model_weights", "model_formula", "model_stepwise"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert len(rows)
    for c in ("confidence",):
        if c in rows and name != "model_network":
            assert rows[c].between(0, 1 + 1e-9).all()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
