import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def compare(duck, df, sql):
    """Rows of a Spark query and of its SQL, columns by name, order left out."""
    cols = df.columns
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(cols)
    text = lambda v: "None" if v is None or v != v else str(v)
    want = sorted(tuple(text(row[names.index(c)]) for c in cols) for row in r.fetchall())
    got = sorted(tuple(text(v) for v in row) for row in df.collect())
    assert got == want
