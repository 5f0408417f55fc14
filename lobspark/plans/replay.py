"""Batch replay: the kernel over each symbol's events in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lobspark.config import Settings
from lobspark.operators.kernel import Kernel
from lobspark.schemas import LEVELS, SIGNAL, UNIFIED_EVENT

REPLAY_OUT = T.StructType([*SIGNAL.fields, T.StructField("outcome", T.StringType()), T.StructField("reason", T.StringType())])
KEYFRAME = T.StructType(
    [
        T.StructField("snapshot_ts_ms", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("last_update_id", T.LongType()),
        T.StructField("snapshot_source", T.StringType()), T.StructField("bids", LEVELS), T.StructField("asks", LEVELS),
    ]
)
#: One row for any output: output is signal, keyframe or counters.
KERNEL_OUT = T.StructType(
    [
        T.StructField("output", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("signal", REPLAY_OUT),
        T.StructField("keyframe", KEYFRAME), T.StructField("counters", T.MapType(T.StringType(), T.LongType())),
    ]
)


def unify(depth: DataFrame, trades: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """One stream of all kinds, with every column of UNIFIED_EVENT."""
    parts = [depth.withColumn("kind", F.lit("depth")), trades.withColumn("kind", F.lit("trade"))]
    if snapshots is not None:
        snap = snapshots.withColumns(
            {"kind": F.lit("snapshot"), "event_ts_ms": F.col("snapshot_ts_ms"), "recv_ts_ms": F.col("snapshot_ts_ms"), "final_update_id": F.col("last_update_id")}
        )
        parts.append(snap)
    out = None
    for p in parts:
        have = set(p.columns)
        full = p.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in UNIFIED_EVENT])
        out = full if out is None else out.unionByName(full)
    return out


def plain(row: dict) -> dict:
    """A kernel row from one that came through Arrow: levels as pairs, ids as integers."""
    pairs = lambda ls: [] if ls is None else [(x["price"], x["size"]) for x in ls]
    whole = lambda v: None if v is None or v != v else int(v)
    ids = ("first_update_id", "final_update_id", "prev_final_update_id", "event_ts_ms", "recv_ts_ms", "arrival_seq")
    return row | {"bids": pairs(row["bids"]), "asks": pairs(row["asks"])} | {k: whole(row[k]) for k in ids}


def tagged(kernel: Kernel, symbol: str, signals: list[dict], *, totals: bool) -> list[dict]:
    """Signals, the keyframes that came with them and, with totals, the counters, as rows of KERNEL_OUT."""
    level = lambda xs: [{"price": p, "size": q} for p, q in xs]
    rows = [{"output": "signal", "symbol": symbol, "signal": x} for x in signals]
    for k in kernel.take_keyframes():
        rows.append({"output": "keyframe", "symbol": symbol, "keyframe": k | {"bids": level(k["bids"]), "asks": level(k["asks"])}})
    if totals:
        rows.append({"output": "counters", "symbol": symbol, "counters": dict(kernel.counters)})
    return rows


def outputs(events: DataFrame, settings: Settings, *, epoch: str | None = None) -> DataFrame:
    """All outputs of the kernel (KERNEL_OUT): signals, keyframes, and counters once a symbol (and epoch).

    A symbol's events are one ordered state machine, so one task; Spark sorts them and they
    stream through it, so a task holds a batch and the kernel's own state. epoch: a column
    that splits a symbol's events into independent stretches (days that begin with a
    snapshot), which then run in parallel. Write the result once to use several outputs.
    """
    keys = ["symbol", *([epoch] if epoch else [])]
    schema = to_arrow_schema(KERNEL_OUT)

    def table(rows: list[dict]) -> pa.RecordBatch:
        flat = [r | {"counters": list(r["counters"].items())} if r.get("counters") else r for r in rows]
        return pa.RecordBatch.from_pylist(flat, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, at = None, None
        for batch in batches:
            rows: list[dict] = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != at:
                    if kernel:
                        rows += tagged(kernel, at[0], signals + kernel.finish(), totals=True)
                    kernel, at, signals = Kernel(settings), key, []
                r["bids"] = [(x["price"], x["size"]) for x in r["bids"] or ()]
                r["asks"] = [(x["price"], x["size"]) for x in r["asks"] or ()]
                signals += kernel.feed(r)
            if kernel:
                rows += tagged(kernel, at[0], signals, totals=False)
                signals = []
            if rows:
                yield table(rows)
        if kernel:
            yield table(tagged(kernel, at[0], kernel.finish(), totals=True))

    dealt = events.repartition(*keys).sortWithinPartitions(*keys, "arrival_seq")
    return dealt.mapInArrow(run, KERNEL_OUT)


def signals_of(out: DataFrame) -> DataFrame:
    return out.where("output = 'signal'").select("signal.*")


def keyframes_of(out: DataFrame) -> DataFrame:
    return out.where("output = 'keyframe'").select("keyframe.*")


def counters_of(out: DataFrame) -> DataFrame:
    """(symbol, name, n), added up over epochs."""
    rows = out.where("output = 'counters'").select("symbol", F.explode("counters").alias("name", "n"))
    return rows.groupBy("symbol", "name").agg(F.sum("n").alias("n"))


def replay(events: DataFrame, settings: Settings, *, epoch: str | None = None) -> DataFrame:
    """Signals of every symbol."""
    return signals_of(outputs(events, settings, epoch=epoch))
