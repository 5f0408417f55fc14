"""Deterministic market views over the driver's tables, in Spark; plans/oracle.py states the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Thirty days in the numbers of book writes.
MONTH = 30 * 100_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    maker = F.col("event_type").isin("click", "signup")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 4).alias("symbol"), _ms("ts").alias("ts_ms"), F.col("event_id").alias("trade_id"),
        maker.alias("buyer_is_maker"), maker.alias("is_bid"), F.col("value").alias("qty"),
        (100 + F.get_json_object("props", "$.k").cast("int") % 10).cast("double").alias("price"),
        F.col("event_type").alias("kind"), "user_id",
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book writes. seq is a number that rises in the order (l_shipdate, l_orderkey, l_linenumber), made
    from the keys themselves, so no global sort is needed."""
    bid = F.col("l_linestatus") == "F"
    off = 0.5 * (1 + F.col("l_partkey") % 40)
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey") % 4).alias("symbol"), bid.alias("is_bid"),
        F.when(bid, 100 - off).otherwise(100 + off).cast("double").alias("price"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("size"),
        (day * 100_000_000_000 + F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), day.alias("day"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey") % 4).alias("symbol"), F.col("o_orderkey").alias("seq"),
        (cents / 100).cast("double").alias("bid"), (cents / 100 + 0.5 + F.col("o_orderkey") % 7 * 0.25).cast("double").alias("ask"),
        (1 + F.col("o_orderkey") % 13).cast("double").alias("bid_qty"), (1 + F.col("o_custkey") % 11).cast("double").alias("ask_qty"),
        "o_orderdate", "o_orderpriority", "o_custkey",
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequenced updates with some broken chains: ids from order keys, one in fifty moved."""
    q = quotes(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("seq")).cast("long"))
    moved = F.when(F.col("seq") % 50 == 0, 3).otherwise(0)
    return q.select(
        "symbol", "seq", (F.col("n") * 10 - 9).alias("first_update_id"), (F.col("n") * 10).alias("final_update_id"),
        (F.col("n") * 10 - 10 - moved).alias("prev_final_update_id"),
    )
