import pytest

from stemmata.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df())
