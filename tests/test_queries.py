"""Every core query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lobspark.plans import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    names = sorted(df.columns)
    text = df[names].astype(object).where(df[names].notna(), None).map(lambda v: repr(float(v)) if isinstance(v, float) else str(v))
    return names, sorted(map(tuple, text.values))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_same_as_sql(spark, db, name):
    want = rows(db.execute(oracle.ORACLE[name]).df())
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == want
    assert want[1], "a query without rows on both sides proves nothing"


def test_every_query_has_sql_but_the_kernel():
    assert set(queries.QUERIES) - set(oracle.ORACLE) == {"kernel_replay"}


def test_level_age_of_a_half(spark, tmp_path):
    """41 of 640 queued are a day old: 0.0640625 ends in a half, which the SQL's round takes down."""
    c = duckdb.connect()
    c.execute("create table lineitem as select i as l_orderkey, i as l_partkey, 0::bigint as l_suppkey, 1 as l_linenumber, size::double as l_quantity, 'N' as l_returnflag, 'F' as l_linestatus, timestamp '1970-01-01' + day * interval 1 day as l_shipdate from (values (1, 599, 11000), (2, 41, 10999)) t(i, size, day)")
    c.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    want = rows(c.execute(oracle.ORACLE["level_age"]).df())
    assert want[1] == [("0.064062", "True", "640.0", "S0")]
    assert rows(queries.QUERIES["level_age"](spark, str(tmp_path)).toPandas()) == want


@pytest.mark.parametrize("odd", ["l_orderkey", "l_shipdate", "l_suppkey", "l_partkey", "l_linestatus"])
def test_level_age_without_a_key(spark, tmp_path, odd):
    """One write of six lacks a number, a day or a part of its level's key."""
    c = duckdb.connect()
    c.execute("create table lineitem as select i as l_orderkey, 3::bigint as l_partkey, 2::bigint as l_suppkey, 1 as l_linenumber, size::double as l_quantity, 'N' as l_returnflag, 'F' as l_linestatus, timestamp '1996-01-01' + i * interval 1 day as l_shipdate from (values (1, 4), (2, 9), (3, 7), (4, 30), (5, 22), (6, 41)) t(i, size)")
    c.execute(f"update lineitem set {odd} = null where l_quantity = 7")
    c.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    want = rows(c.execute(oracle.ORACLE["level_age"]).df())
    assert want[1] and rows(queries.QUERIES["level_age"](spark, str(tmp_path)).toPandas()) == want
