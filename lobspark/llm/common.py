"""Shared pieces of the training-data operators: words, digests, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The columns of ``documents``.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def bind(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once a row, also when lambdas use it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only a session on one machine may do without (tests, a laptop): it gets a local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lobspark-")
        shared_dir.own = found
    return found.rstrip("/")


_cut: list[str] = []


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps later readers columnar. This runs
    df at once, so an operator that cuts does part of its work while its result is built.
    The table goes when the driver ends, or earlier by ``cleared``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lobspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, place = _folder(spark, path)
    fs.deleteOnExit(place)
    _cut.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    fs, place = _folder(spark, path)
    fs.delete(place, True)


@contextmanager
def cleared(spark: SparkSession):
    """Tables that are cut inside go at the end; what was made of them must have been written by then."""
    before = len(_cut)
    try:
        yield
    finally:
        for path in _cut[before:]:
            drop_table(spark, path)
        del _cut[before:]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
