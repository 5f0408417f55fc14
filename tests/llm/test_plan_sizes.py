"""Plans that do not grow with what they repeat: the driver holds and plans them again after every stage."""

from pyspark.sql import functions as F

from lobspark.llm import line_dedup, sharding


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shards_of_many_levels_have_a_plan_without_joins(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), F.col("id").cast("int")).alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang"))
    keys, n = sharding.placed(docs, 24, 0.001)
    assert n == 200 and keys.select("node").distinct().count() == 24
    assert "Join" not in plan(keys)


def test_line_dedup_plans_what_it_was_told_once(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e"), (2, "a b c\nd e")], "doc_id long, text string")
    assert plan(line_dedup.dedup(docs, passage_words=50)).count("Generate ") <= 10
