"""Sharding: k-d tree partitioning over document metadata (native), law ``bytes``.

All nodes of a level split together. One pass over the keys makes a coarse histogram of
every dimension in every node: it tells the widest dimension and the bin that holds the
weighted median (a node of k leaves gives floor(k/2)/k of its bytes to the left). Further
passes look into that bin only, until the cut misses its mark by no more than the slack,
or is exact. A node's histogram becomes one array, no longer than a digit has values; one
row a node and dimension comes to the driver, and one row a node goes out again, in a
table that a broadcast join puts beside the keys: its rows are proven to be n_shards at
most. Each level's nodes are written with the keys, so plans grow neither with the number
of shards nor with the levels, and a pass has the code of the same pass a level before. No
pass sorts or moves the keys.

Below the 20 bits of the dimension's value the order goes on with hashes of the text, the
id and the row, so a hot value or a large group of equal texts is cut where the bytes ask
for it; otherwise equal texts stay next to each other. Slots are dealt in buckets, not in
one sort a shard.

Building the result runs the jobs that find the cuts; the result itself is lazy.

Defined results: a null text has size 8 (crc32 of the empty text); null metadata is a
value of its own; very long texts are read once, for their hashes; repeated rows are
dealt like others; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.llm.common import cut

VALUE, TEXT, ROW = 20, 20, 40
TOP = (1 << VALUE) - 1
#: Bits looked at by pass: of value and text's hash together, then of the row's.
DIGITS = (12, 14, 14, 14, 13, 13)
#: Metadata dimensions, each scaled to [0, 1] over the table before use.
DIMENSIONS = {
    "source": lambda: F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")).cast("double"),
    "lang": lambda: F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")).cast("double"),
    "size": lambda: F.log2(F.col("size").cast("double")),
    "doc": lambda: F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)),
}


@dataclass
class Node:
    """A part of the tree that still holds several leaves; rows under (cut1, cut2) on dim go left."""

    first: int
    leaves: int
    weight: int
    dim: int = 0
    prefix: int = 0
    below: int = 0
    cut1: int = 0
    cut2: int = 0
    heavy: int = 0

    @property
    def goal(self) -> float:
        return self.weight * (self.leaves // 2) / self.leaves


def _beside(keys: DataFrame, rows: list[tuple], schema: str, how: str) -> DataFrame:
    """keys with the row of their node; rows has one for each node, n_shards at most."""
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    mark = {"int": "", "long": "L", "double": "D"}
    row_of = lambda row: "(" + ", ".join(f"{v!r}{mark[k]}" for v, k in zip(row, kinds, strict=True)) + ")"
    table = keys.sparkSession.sql(f"select * from values {', '.join(map(row_of, rows))} as t({', '.join(names)})")
    return keys.join(F.broadcast(table), "node", how)


def _median(bins: DataFrame, group: list[str], *more: Column) -> DataFrame:
    """Of (.., bin, w, goal, below): the first bin at whose end the goal is reached, with what lies below it.

    A group's bins are one array, of no more entries than a digit has values.
    """
    each = bins.groupBy(*group, "goal", "below").agg(F.sort_array(F.collect_list(F.struct("bin", "w"))).alias("bins"), *more)
    start = F.struct(F.col("below").alias("end"), F.lit(-1).cast("long").alias("bin"), F.col("below").alias("start"), F.lit(0).cast("long").alias("w"))

    def add(a: Column, x: Column) -> Column:
        end = a["end"] + x["w"]
        bin_ = F.when(end >= F.col("goal"), x["bin"]).otherwise(F.lit(-1).cast("long"))
        return F.when(a["bin"] >= 0, a).otherwise(F.struct(end.alias("end"), bin_.alias("bin"), a["end"].alias("start"), x["w"].alias("w")))

    return each.withColumn("m", F.aggregate("bins", start, add)).drop("bins", "goal", "below")


def _k1(dim: Column) -> Column:
    return F.shiftleft(F.get(F.array(*[F.col(f"v_{d}") for d in DIMENSIONS]), dim), TEXT) + F.col("by_text")


def _coarse(keys: DataFrame, nodes: dict[int, Node]) -> None:
    """Widest dimension of every node and the bin of its median."""
    at = _beside(keys, [(n.first, n.goal) for n in nodes.values()], "node int, goal double", "inner")
    values = F.array(*[F.col(f"v_{d}") for d in DIMENSIONS])
    at = at.select("node", "goal", "size", F.posexplode(values).alias("dim", "v"))
    bins = at.groupBy("node", "dim", "goal", F.shiftright("v", VALUE - DIGITS[0]).alias("bin")).agg(
        F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    span = (F.max("hi") - F.min("lo")).alias("span")
    widest: dict[int, tuple] = {}
    for r in _median(bins.withColumn("below", F.lit(0).cast("long")), ["node", "dim"], span).select("node", "dim", "span", "m.*").collect():
        n, rank = nodes[r["node"]], (r["span"], -r["dim"])
        if n.first not in widest or rank > widest[n.first]:
            widest[n.first] = rank
            n.dim, n.prefix, n.below, n.heavy = r["dim"], r["bin"], r["start"], r["w"]


def _finer(keys: DataFrame, nodes: list[Node], k: int) -> None:
    """Look into the bin that pass k - 1 left of every node."""
    rows = [(n.first, n.dim, n.goal, n.below, n.prefix, n.cut1) for n in nodes]
    at = _beside(keys, rows, "node int, dim int, goal double, below long, prefix long, cut1 long", "inner")
    at = at.withColumn("k1", _k1(F.col("dim")))
    done, bits = sum(DIGITS[:k]), sum(DIGITS[: k + 1])
    wide = VALUE + TEXT
    if k < 3:
        inside = F.shiftright("k1", wide - done) == F.col("prefix")
        digit = F.shiftright("k1", wide - bits)
    else:
        inside = F.col("k1") == F.col("cut1")
        if k > 3:
            inside &= F.shiftright("by_row", wide + ROW - done) == F.col("prefix")
        digit = F.shiftright("by_row", wide + ROW - bits)
    bins = at.where(inside).groupBy("node", "goal", "below", digit.alias("bin")).agg(F.sum("size").alias("w"))
    by = {n.first: n for n in nodes}
    for r in _median(bins, ["node"]).select("node", "m.*").collect():
        n = by[r["node"]]
        n.prefix, n.below, n.heavy = r["bin"], r["start"], r["w"]


def _cuts(keys: DataFrame, level: list[Node], slack: float) -> None:
    """Set the cut of every node of a level, and leave in below what lies under it."""
    nodes = {n.first: n for n in level if n.weight}
    todo = list(nodes.values())
    wide = VALUE + TEXT
    for k in range(len(DIGITS)):
        if not todo:
            break
        _coarse(keys, nodes) if k == 0 else _finer(keys, todo, k)
        rest = []
        for n in todo:
            left, right = n.goal - n.below, n.below + n.heavy - n.goal
            if k < len(DIGITS) - 1 and n.heavy > slack and min(left, right) > slack / 2:
                if k == 2:
                    n.cut1 = n.prefix
                rest.append(n)
                continue
            end = right < left  # cut behind the bin, else before it
            edge, bits = n.prefix + end, sum(DIGITS[: k + 1])
            n.below += n.heavy * end
            if k < 3:
                n.cut1, n.cut2 = edge << (wide - bits), 0
            else:
                n.cut2 = edge << (wide + ROW - bits)
        todo = rest


def _go(keys: DataFrame, level: list[Node]) -> DataFrame:
    """Every row moves to the side of its node's cut."""
    rows = [(n.first, n.dim, n.cut1, n.cut2, n.leaves // 2) for n in level]
    at = _beside(keys, rows, "node int, dim int, cut1 long, cut2 long, jump int", "left")
    k1 = _k1(F.coalesce("dim", F.lit(0)))
    under = (k1 < F.col("cut1")) | ((k1 == F.col("cut1")) & (F.col("by_row") < F.col("cut2")))
    node = F.when(F.col("dim").isNull() | under, F.col("node")).otherwise(F.col("node") + F.col("jump"))
    return at.select(*[node.alias("node") if c == "node" else c for c in keys.columns])


def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "text", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"))
    slim = slim.select(
        "doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 64 - TEXT).alias("by_text"),
        (
            F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id"), 44), 20)
            + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 44)
        ).alias("by_row"),
        *[make().alias(f"raw_{d}") for d, make in DIMENSIONS.items()],
    )
    return cut(slim, "shard-keys")


def placed(docs: DataFrame, n_shards: int, slack: float) -> tuple[DataFrame, int]:
    """Keys of all rows with their shard in ``node``, and the number of rows."""
    slim = _keys(docs)
    ends = slim.agg(
        F.sum("size").alias("size"), F.count("*").alias("n"),
        *[f(f"raw_{d}").alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    scaled = []
    for d in DIMENSIONS:
        lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        scaled.append(((F.col(f"raw_{d}") - lo) / ((hi - lo) or 1.0) * TOP).cast("long").alias(f"v_{d}"))
    keys = slim.select(F.lit(0).alias("node"), "doc_id", "size", "text_crc32", "by_text", "by_row", *scaled)
    level = [Node(0, n_shards, ends["size"] or 0)] if n_shards > 1 and ends["n"] else []
    while level:
        _cuts(keys, level, slack * ends["size"] / n_shards)
        keys = cut(_go(keys, level), "shard-level")
        sides = [
            s for n in level
            for s in (Node(n.first, n.leaves // 2, n.below), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2, n.weight - n.below))
        ]
        level = [s for s in sides if s.leaves > 1]
    return keys, ends["n"]


def shard(
    docs: DataFrame, *, n_shards: int | None = 24, target_bytes: int | None = None, slack: float = 0.001, slot_bucket: int = 4096
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row a row of docs.

    n_shards, or as many as hold target_bytes each. slack: bytes a cut may miss its mark,
    as a part of a leaf's target; documents are not divided, so the largest document
    bounds it as well.
    """
    if target_bytes:
        size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 0
        n_shards = max(1, math.ceil(size / target_bytes))
    keys, n = placed(docs, n_shards, slack)
    buckets = max(1, math.ceil(n / (n_shards * slot_bucket)))
    keys = keys.withColumnRenamed("node", "shard").withColumn("bucket", F.pmod(F.xxhash64("by_row"), F.lit(buckets)))
    counts = keys.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("by_text", "by_row", "doc_id"))
    slots = keys.withColumn("rank", rank).join(counts, ["shard", "bucket"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
