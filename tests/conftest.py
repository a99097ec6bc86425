import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and a DuckDB result hold the same columns and rows, in any order."""
    import decimal

    def plain(v):
        if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
            return repr(float(v) + 0.0)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def check(df, got):
        names = sorted(df.columns)
        assert names == sorted(got.columns)
        a = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        b = sorted((tuple(plain(dict(zip(got.columns, r))[c]) for c in names) for r in got.fetchall()), key=repr)
        assert a == b

    return check
