import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def _value(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(int(x))
    if isinstance(x, float) or type(x).__name__ in ("float32", "float64", "Decimal"):
        return repr(float(x))
    return str(int(x)) if type(x).__name__.startswith(("int", "uint")) else str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_value(x) for x in row) for row in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="session")
def same():
    """Compare a query with its SQL, whatever the order of rows; whole numbers that pandas made floats count as equal."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def check(df, sql):
        from pyspark.sql import types as T

        mine, theirs = df.toPandas(), con.execute(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)):
                mine[f.name], theirs[f.name] = mine[f.name].astype("Float64").astype("float64"), theirs[f.name].astype("Float64").astype("float64")
        assert rows_of(mine) == rows_of(theirs)

    return check
