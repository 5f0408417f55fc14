"""Exact top-k search: an impact-ordered index, read score-at-a-time.

A shard of vectors is indexed by quantised impact. A posting segment is the list of the
candidates whose component on one dimension has one sign and one impact level; segments
lie from the highest level down, and a posting is an id alone, as its segment has the
impact. Reading a segment adds query component times impact to the accumulators of its
candidates. What a candidate's accumulator still lacks, by segments not read and by
quantising those that were, is a residual vector whose length the index knows after every
level; by Cauchy-Schwarz it changes the score by |query| x |residual| at most. Reading
stops only when that bound proves that few candidates can still reach the k-th score
found so far, or when all levels are read; then every possible member is scored exactly
in integers. The k-th score carries over from block to block of a shard.

Every candidate travels once, to its shard; queries go to all shards, and stream through
a shard's index in batches, so a task holds one index and one batch. Nothing is broadcast.
With a fixed set of queries all of this is linear in the number of candidates.

Defined results: vectors that are null, empty, or hold a null or non-finite component
take no part; vectors of different lengths meet as if padded with zeros; very long
vectors are as many lists of segments; rows with equal ids are different candidates
(however many there are, shards stay even), but never for a query of their own id, and
ask once (by the least vector); ties go to the smaller id; null ids take no part; scores
beyond 2**63 are held there; further columns are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.llm import tokens as tk
from lobspark.llm.common import partitions

#: Impact levels of a block, equal steps up to its largest component.
LEVELS = 8
#: Candidates of an index block, and queries that are searched together.
BLOCK, TOGETHER = 8192, 128


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, or null if a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Block:
    """The impact-ordered index of some vectors (integers, one row each)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors).astype(np.float64)
        self.step = size.max(initial=0.0) / LEVELS or 1.0
        level = np.minimum(np.ceil(size / self.step), LEVELS).astype(np.int8)
        residual = vectors.astype(np.float64)
        # of levels from the highest down: (impact, [(dimension, candidates)])
        self.levels: list[tuple[float, list[tuple[int, np.ndarray]]]] = []
        # rounding: each of a candidate's components is added once
        rounding = (vectors.shape[1] + 8) * 2.0**-50 * np.sqrt((size**2).sum(1))
        self.lacking = [np.sqrt((residual**2).sum(1)) + rounding]
        for at in range(LEVELS, 0, -1):
            impact = (at - 0.5) * self.step
            for sign in (1, -1):
                here = (level == at) & ((vectors > 0) if sign > 0 else (vectors < 0))
                dims, rows = np.nonzero(here.T)
                edges = np.searchsorted(dims, np.arange(vectors.shape[1] + 1))
                segments = [(d, rows[i:j]) for d, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
                self.levels.append((sign * impact, segments))
                residual[here] -= sign * impact
                self.lacking.append(np.sqrt((residual**2).sum(1)) + rounding)

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
        """Positions that can still be among the k best of each query, given the k-th score so far; segments read."""
        n, dims = len(self.ids), self.vectors.shape[1]
        sums = np.zeros((n, len(queries)))  # accumulators, a row for each candidate
        reach = np.sqrt((queries[:, :dims] ** 2).sum(1)) * (1 + 1e-9)
        few, read = max(4 * k, n // 64), 0
        for done, (impact, segments) in enumerate(self.levels, 1):
            for d, rows in segments:
                if d < queries.shape[1]:
                    sums[rows] += impact * queries[:, d]
            read += len(segments)
            if done % 2 and done < len(self.levels):
                continue  # both signs of a level
            slack = np.outer(self.lacking[done], reach) + 1e-6
            least = sums - slack
            least[own] = -np.inf
            kth = floor
            if n > k:
                kth = np.maximum(floor, np.partition(least, n - k, axis=0)[n - k])
            can = sums + slack >= kth
            can[own] = False
            if can.sum(0).max(initial=0) <= few:
                break
        return [np.flatnonzero(x) for x in can.T], read


def exact_scores(q: np.ndarray, rows: np.ndarray) -> list[int]:
    """Integer inner products, held to 64 bits."""
    width = min(len(q), rows.shape[1])
    q, rows = q[:width], rows[:, :width]
    if float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, width) < 2**62:
        return [int(x) for x in rows @ q]
    whole = [int(x) for x in q]
    return [max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(whole, r, strict=True)))) for r in rows]


def _stack(lists: pa.Array) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Shard:
    """Blocks over the candidates of one shard."""

    def __init__(self, batches: list[pa.RecordBatch], k: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, vectors = table["vec_id"].to_numpy(), _stack(table["v"].combine_chunks())
        self.k, self.blocks = k, [Block(ids[i : i + BLOCK], vectors[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]

    def best(self, ids: np.ndarray, queries: np.ndarray) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score) of the k best candidates here of each query."""
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        floor, wide = np.full(len(ids), -np.inf), queries.astype(np.float64)
        for block in self.blocks:
            own = block.ids[:, None] == ids[None, :]
            for j, at in enumerate(block.search(wide, own, floor, self.k)[0]):
                if len(at):
                    scored = zip(exact_scores(queries[j], block.vectors[at]), (-int(x) for x in block.ids[at]), strict=True)
                    best[j] = sorted([*best[j], *scored], reverse=True)[: self.k]
                    if len(best[j]) == self.k:
                        floor[j] = best[j][-1][0] * (1 - 1e-15) - 1 if best[j][-1][0] > 0 else best[j][-1][0] * (1 + 1e-15) - 1
        return [(int(q), -c, s) for q, b in zip(ids, best, strict=True) for s, c in b]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, shard_rows: int = 16_384, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of every row that is_query.

    vectors: (vec_id, embedding).
    """
    rows = vectors.select("vec_id", integers(F.col("embedding"), scale).alias("v"), is_query.alias("q"))
    rows = rows.where("v is not null and vec_id is not null")
    shards = max(partitions(vectors.sparkSession), math.ceil(rows.count() / shard_rows))
    # by place, not by value: copies of a row are spread like others
    deal = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    found = rows.select(deal.alias("sh"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("sh"), F.lit(True).alias("asks"), "vec_id", "v")
    both = found.unionByName(asked).repartitionById(shards, F.col("sh")).sortWithinPartitions("sh", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            sh, asks = batch["sh"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((sh[1:] != sh[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if sh[i] != at:
                    at, held, shard = sh[i], [], None
                if not asks[i]:
                    held.append(batch.slice(i, j - i))
                    continue
                if not held and shard is None:
                    continue  # a shard without candidates
                if shard is None:
                    shard, held = Shard(held, k), []
                for a in range(i, j, TOGETHER):
                    part = batch.slice(a, min(TOGETHER, j - a))
                    out = shard.best(part["vec_id"].to_numpy(), _stack(part["v"]))
                    columns = list(zip(*out, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
        tk.release()

    met = both.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
