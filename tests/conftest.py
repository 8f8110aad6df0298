"""A session and small tables for the tests."""

import os
import sys
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.fixture(scope="session")
def found(spark):
    """Rows of a query over a folder of tables, counted."""
    import __spark_entry__ as entry

    return lambda name, sf_dir=SF: Counter(tuple(r) for r in entry.queries()[name](spark, str(sf_dir)).collect())


@pytest.fixture(scope="session")
def put():
    """Writes a table of rows to a folder."""

    def write(sf_dir, name, rows, **types):
        pq.write_table(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())}), f"{sf_dir}/{name}.parquet")

    return write


def plain(x):
    """x, with numbers that may differ in the last bits rounded."""
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE"}
#: Two histograms of a bounded number of rows, or two rows of settings, are compared by range.
RANGES = {"agg6_percentiles", "mg18_auc"}


def same_as_sql(spark, db, name, query, sql):
    """Checks that a query gives the rows of its SQL, whatever the order of columns and rows, with the same types, and by a plan that scales."""
    df = query(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert name in RANGES or "BroadcastNestedLoopJoin" not in plan
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = db.sql(sql)
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert want, "the SQL gives no row"
    assert got == want, f"only in Spark: {list((got - want).items())[:5]}; only in SQL: {list((want - got).items())[:5]}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    assert kinds == {c: str(t) for c, t in zip(rel.columns, rel.types)}
