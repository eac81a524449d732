import glob
import os
import sys
import tempfile

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_THREADS', 4)}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether two pandas frames hold the same rows, in any order."""

    def canon(df):
        def one(v):
            if hasattr(v, "tolist"):
                v = v.tolist()
            if v is None or v is pd.NA or v != v:
                return None
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

        return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert canon(a) == canon(b)

    return check
