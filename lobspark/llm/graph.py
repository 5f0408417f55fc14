"""Connected components by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, label), label the least node of the component; only linked nodes.

    Links are cut to the shared folder once a round; the number of rounds grows with the
    logarithm of the longest path. Least neighbours meet links by the node's complement, so
    that both sides are dealt anew and the links of a hub can be split. The rounds end when
    the set of links stays the same, told by its size and 128 bits.
    """
    down = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    state = lambda df: df.agg(F.count("*"), total("a", "b"), total(F.lit(1), "b", "a")).first()
    beside = lambda df, least: df.join(least.select(F.bitwise_not("a").alias("__a"), "m"), F.bitwise_not("a") == F.col("__a"))
    links = cut(down(links), "links")
    before = state(links)
    while before[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = down(beside(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = beside(large, least)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = cut(down(small.select("x.*")), "links")
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
