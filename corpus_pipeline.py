"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), does its work on all rows it is given and returns
a DataFrame that is written as Parquet and read again by the next. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lobspark.llm import jaccard_join, line_dedup, mixing, quality, sentencepiece_codec
from lobspark.llm.common import DOCUMENT_COLUMNS, cleared, documents, drop_table, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lose too much text to failed lines; drop failed lines.

    Null, empty and blank texts have no words and go. Repeated rows are judged each; a very
    long text is one row's work. Further columns than those of documents are dropped.
    """
    return quality.clean(docs.select(*DOCUMENT_COLUMNS))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out chunks of lines and passages of 50 words and more that an earlier document holds.

    Null and empty texts stay as they are; a document that had words and lost them all goes.
    Rows with one id and text are one document and lose the same; a null id is the least.
    """
    return line_dedup.deduped_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8.

    Documents without words (null, empty) are linked with nothing and stay, each row of
    equal ones but once. The least id stays of a group, null last; equal rows stay once.
    """
    return jaccard_join.deduplicated(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, left out or cut at a block's edge.

    A null source is a source. Documents without words take no part, as nothing is taken of
    them. Repeated rows are dealt each.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them.

    A null text has null ids, an empty one none; rows are encoded each, giants in chunks.
    """
    coded = sentencepiece_codec.round_trip(docs)
    return coded.select("doc_id", "source", "lang", "n_chars", "n_tokens", "ids", "exact")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the merges of the encoder; tests/llm/test_pipeline_plain.py has a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    top = f"{shared_dir(spark)}/lobspark/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with cleared(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{top}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{top}/{i}")
        if i:
            drop_table(spark, f"{top}/{i - 1}")
    return docs
