import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same_rows():
    """Whether a Spark result and a DuckDB result hold the same rows and columns, doubles to six digits."""
    import pandas as pd

    def norm(df):
        df = df.reindex(sorted(df.columns), axis=1)
        cell = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
        return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert norm(a) == norm(b)

    return check


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c
