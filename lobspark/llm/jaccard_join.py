"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Documents are packed into chunks of a bounded size as they are read, so equal rows are
   spread like others. A chunk sends its distinct shingles (32 bits within hash buckets)
   with document counts and gets back corpus-wide counts, as one byte each. Counts only order shingles, so shared bits make a shingle look less
   rare and lose nothing.
2. Each document's shingles are put in (count, hash) order. Those in its prefix that some
   other document has as well become postings; equal sets are one node.
3. Postings meet by shingle. First each list's leader (where the shingle stands earliest)
   meets its members; verified pairs merge. Then only members of lists that still hold
   several components meet across them. A large family of near copies thus costs about
   one verification a member, and no pair of one component is listed.
4. Pairs that pass the filters are verified once on their whole sets, and components of
   all links are found by stars.

The components are those of all links: a pair that is never listed is either ruled out by
a filter or already connected.

Defined results: a null or blank text has no shingles and is alone; with fewer words than
a shingle the whole sequence is one; rows with null ids take part, and a component whose
ids are all null has a null id; repeated rows share a component; further columns are not
read; a very long text is a chunk of its own, linear in its words but for sorting; an empty
table gives an empty table. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.llm import tokens as tk
from lobspark.llm.common import cut, partitions
from lobspark.llm.chunks import pack_chunks, unpacked
from lobspark.llm.graph import components

_NEXT = np.uint64(0xA0761D6478BD642F)
_SHORT = np.uint64(0xE7037ED1A0B428DB)
#: Equal hash ranges whose sizes bound an overlap from above (suffix filter).
PARTS = 16


def shingles(text: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle) of all distinct shingles, sorted by both."""
    hashes, upto = tk.token_hashes(text)
    size = np.diff(upto)
    grams = hashes
    for _ in range(n - 1):
        grams = tk.mix(grams[:-1] * _NEXT + hashes[len(hashes) - len(grams) + 1 :]) if len(grams) else grams
    doc = np.repeat(np.arange(len(size)), size)
    depth = np.arange(len(hashes)) - np.repeat(upto[:-1], size)
    full = depth + n <= np.repeat(size, size)
    docs, keys = [doc[full]], [grams[np.flatnonzero(full)]]
    for few in range(1, n):
        short = np.flatnonzero(size == few)
        if len(short):
            whole = hashes[upto[short]]
            for i in range(1, few):
                whole = tk.mix(whole * _NEXT + hashes[upto[short] + i])
            docs.append(short)
            keys.append(tk.mix(whole + np.full(1, _SHORT) * np.uint64(few)))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def _posts(doc: np.ndarray, key: np.ndarray, buckets: int):
    """Distinct (bucket, 32 bits) of shingles, where each shingle is among them, and document counts."""
    short = (tk.bucket_of(key, buckets) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
    return np.unique(short, return_inverse=True, return_counts=True)


def _table(columns: dict) -> pa.Table:
    return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x[0], x[1]) for x in columns.values()], names=list(columns))


def prefixes(docs: DataFrame, *, n: int, percent: int, partition_bytes: int = 8 << 20) -> DataFrame:
    """One row a row of docs: (doc_id, row_key, node, n_shingles, keys, places, sizes, members).

    keys are prefix shingles that other documents have as well, places their positions in
    rare-first order; members, the whole set, is null where there are none.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), math.ceil(n_bytes / partition_bytes))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 24
    dealt = pack_chunks(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"), size.alias("bytes")), partition_bytes)

    @tk.frugal
    def send(table: pa.Table) -> pa.Table:
        keys, _, counts = _posts(*shingles(unpacked(table)["text"], n), parts)
        edges = np.searchsorted(keys >> np.uint64(32), np.arange(parts + 1))
        own, rows = table["chunk"][0].as_py(), []
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                low = (keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((own, b, low.tobytes(), *tk.pack(counts[i:j])))
        chunk, bucket, low, small, large = zip(*rows, strict=True) if rows else ((),) * 5
        return _table({"chunk": (chunk, pa.int64()), "bucket": (bucket, pa.int32()), "keys": (low, pa.binary()), "small": (small, pa.binary()), "large": (large, pa.binary())})

    @tk.frugal
    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        counts = [tk.unpack(*x) for x in zip(table["small"].to_pylist(), table["large"].to_pylist(), strict=True)]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts)).astype(np.int64)[where]
        back = [tk.pack(x) for x in np.split(total, np.cumsum([len(x) for x in keys])[:-1])]
        small, large = zip(*back, strict=True)
        return pa.Table.from_arrays(
            [table["chunk"], table["bucket"], pa.array(small, pa.binary()), pa.array(large, pa.binary())], names=["chunk", "bucket", "small", "large"]
        )

    @tk.frugal
    def order(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = unpacked(table)
        rows = len(table)
        doc, key = shingles(table["text"], n)
        _, where, _ = _posts(doc, key, parts)
        told = answers.sort_by("bucket")
        total = [tk.unpack(*x) for x in zip(told["small"].to_pylist(), told["large"].to_pylist(), strict=True)]
        count = np.concatenate(total)[where] if len(key) else np.empty(0, np.int64)
        size = np.bincount(doc, minlength=rows)
        first = np.concatenate([[0], np.cumsum(size)])
        by = np.lexsort((key, count, doc))
        place = np.arange(len(key)) - np.repeat(first[:-1], size)
        reach = size - (percent * size + 99) // 100 + 1
        use = (place < np.repeat(reach, size)) & (count[by] > 1)
        picked = np.bincount(doc[by][use], minlength=rows)
        offsets = pa.array(np.concatenate([[0], np.cumsum(picked)]), pa.int32())
        ranges = np.bincount(doc * PARTS + (key >> np.uint64(60)).astype(np.int64), minlength=rows * PARTS).astype(np.int32)
        sums = np.zeros(rows, np.uint64)
        flips = np.zeros(rows, np.uint64)
        some = np.flatnonzero(size)
        if len(some):
            sums[some] = np.add.reduceat(tk.mix(key), first[some])
            flips[some] = np.bitwise_xor.reduceat(key, first[some])
        node = tk.mix(tk.mix(sums) + flips * _NEXT + size.astype(np.uint64)).view(np.int64)
        members = [key[first[i] : first[i + 1]].tobytes() if picked[i] else None for i in range(rows)]
        return _table({
            "doc_id": table["doc_id"].combine_chunks(), "row_key": table["row_key"].combine_chunks(), "node": (node, pa.int64()), "n_shingles": (size, pa.int64()),
            "keys": pa.ListArray.from_arrays(offsets, pa.array(key[by][use].view(np.int64))),
            "places": pa.ListArray.from_arrays(offsets, pa.array(place[use].astype(np.int32))),
            "sizes": pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * PARTS, pa.int32()), pa.array(ranges)),
            "members": (members, pa.binary()),
        })

    sent = dealt.groupBy("chunk").applyInArrow(send, "chunk long, bucket int, keys binary, small binary, large binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, small binary, large binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        order,
        "doc_id long, row_key long, node long, n_shingles long, keys array<long>, places array<int>, sizes array<int>, members binary",
    )


def _passes(percent: int, x: str, y: str) -> Column:
    """Length, positional and suffix filters on two postings of one shingle."""
    c = lambda side, name: F.col(f"{side}.{name}")
    a, b = c(x, "n_shingles"), c(y, "n_shingles")
    need = F.ceil((a + b) * percent / (100.0 + percent) - 1e-9)
    ahead = F.lit(1) + F.least(a - c(x, "place") - 1, b - c(y, "place") - 1)
    suffix = F.aggregate(F.zip_with(c(x, "sizes"), c(y, "sizes"), lambda p, q: F.least(p, q)), F.lit(0), lambda s, p: s + p)
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (ahead >= need) & (suffix >= need)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    sets = lambda side: nodes.select(F.col("node").alias(side), F.col("members").alias(f"m_{side}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(batch["m_a"].to_pylist(), batch["m_b"].to_pylist(), strict=True)):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep, pa.int64())), batch["b"].take(pa.array(keep, pa.int64()))], ["a", "b"])
        tk.release()

    return both.select("a", "b", "m_a", "m_b").mapInArrow(check, "a long, b long")


def similar(docs: DataFrame, *, n: int = 5, percent: int = 80, partition_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, keeper) of every row of docs.

    Two documents link when 100 * intersection >= percent * union of their n-word shingle
    sets. component_id: least doc_id reachable. keeper: the row to keep of each component
    (least id; documents without shingles keep themselves); equal rows share it.
    """
    table = cut(prefixes(docs, n=n, percent=percent, partition_bytes=partition_bytes), "prefixes")
    nodes = cut(table.where("members is not null").select("node", "n_shingles", "keys", "places", "sizes", "members").dropDuplicates(["node"]), "nodes")
    posts = nodes.select("node", "n_shingles", "sizes", F.explode(F.arrays_zip("keys", "places")).alias("p"))
    posts = posts.select("node", "n_shingles", "sizes", F.col("p.keys").alias("key"), F.col("p.places").alias("place"))
    pair = lambda x, y: (F.greatest(f"{x}.node", f"{y}.node").alias("a"), F.least(f"{x}.node", f"{y}.node").alias("b"))

    lead = F.min(F.struct("place", "n_shingles", "node", "sizes")).alias("lead")
    leaders = posts.groupBy("key").agg(lead, F.count("*").alias("m")).where("m > 1").select(F.bitwise_not("key").alias("other"), "lead.*")
    # aggregates meet postings by the key's complement: both sides are dealt anew and Spark can split a hot shingle
    met = F.bitwise_not("x.key") == F.col("y.other")
    near = posts.alias("x").join(leaders.alias("y"), met & (F.col("x.node") != F.col("y.node")) & _passes(percent, "x", "y"))
    first = cut(near.select(*pair("x", "y")).distinct(), "pairs")
    links = cut(_verified(first, nodes, percent), "links")
    labels = cut(components(links), "labels")

    posts = posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    posts = cut(posts, "posts")
    lists = posts.groupBy("key").agg(F.min(F.struct("place", "n_shingles", "node", "label")).alias("l"), F.min("label").alias("p"), F.max("label").alias("q"))
    lists = lists.where("p <> q").select(F.bitwise_not("key").alias("other"), F.col("l.node").alias("lead"), F.col("l.label").alias("main"))
    rest = cut(posts.join(lists, F.bitwise_not("key") == F.col("other")).drop("other"), "rest")
    others = rest.where("label <> main")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & (F.col("y.node") != F.col("y.lead"))
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    across = others.alias("x").join(rest.alias("y"), apart & once & _passes(percent, "x", "y"))
    second = across.select(*pair("x", "y")).distinct().join(first, ["a", "b"], "left_anti")
    more = _verified(second, nodes, percent)
    joined = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)
    labels = components(joined)

    slim = table.select("doc_id", "row_key", "node", "n_shingles")
    slim = slim.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = slim.withColumn("label", F.when(F.col("n_shingles") > 0, F.col("label")))
    heads = placed.where("label is not null").groupBy("label").agg(
        F.min("doc_id").alias("least"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("head"),
    )
    # written first, so that the join deals both sides anew and Spark can split a hot label
    out = placed.join(cut(heads, "heads"), "label", "left")
    return out.select(
        "doc_id", "row_key", "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (F.col("label").isNull() | (F.col("head.row_key") == F.col("row_key"))).alias("keeper"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of each component; same columns."""
    from pyspark.sql import Window

    keep = similar(docs, **options).where("keeper").select(F.col("row_key").alias("__key")).distinct()
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    first = F.row_number().over(Window.partitionBy("__key").orderBy("doc_id"))
    return rows.join(keep, "__key", "left_semi").withColumn("__no", first).where("__no = 1").select(*docs.columns)
