"""Queries against their SQL, and the pipeline's stages against what they promise."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from lobspark.llm import common, jaccard_join, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    names = sorted(df.columns)
    text = df[names].astype(object).where(df[names].notna(), None).map(lambda v: repr(float(v)) if isinstance(v, float) else str(v))
    return names, sorted(map(tuple, text.values))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, db, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(queries.ORACLE[name]).df())


def test_pipeline(spark, tmp_path):
    d, kept = common.documents(spark, SF), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, SF)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == common.DOCUMENT_COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = d.count()
    assert kept["quality rules"] >= kept["line dedup"] >= kept["n-gram jaccard join"] > 0
    left = spark.read.parquet(f"{tmp_path}/2")
    found = jaccard_join.similar(left, n=5, percent=80)
    assert found.where("component_id <> doc_id").count() == 0
    assert d.where("not exact").count() == 0
    again = corpus_pipeline.run(spark, SF)
    key = lambda x: sorted(map(tuple, x.select("doc_id", "n_tokens").collect()))
    assert key(again) == key(d)
