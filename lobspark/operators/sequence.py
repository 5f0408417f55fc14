"""Sequence checks, bridges, order of arrival and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.windows import lagged, numbered, running_max


def gaps(events: DataFrame, *, overlap_allowed: bool = False, by: str = "symbol", order: str = "seq", width: int = 1 << 20) -> DataFrame:
    """events with the final id before them and whether the chain breaks there; sorted in blocks of width of order."""
    d = lagged(events, ["final_update_id"], "prev_seen", by=by, order=order, width=width)
    d = d.withColumn("prev_seen", F.col("prev_seen.final_update_id"))
    stale = F.col("final_update_id") <= F.col("prev_seen")
    follows = F.col("first_update_id") <= F.col("prev_seen") + 1 if overlap_allowed else F.col("prev_final_update_id") == F.col("prev_seen")
    outcome = F.when(F.col("prev_seen").isNull(), "first").when(stale, "ignored").when(follows, "ok").otherwise("gap")
    return d.withColumn("outcome", outcome)


def bridge(events: DataFrame, snapshots: DataFrame, width: int = 1024) -> DataFrame:
    """The first event of each snapshot whose id range covers last_update_id + 1.

    An event stands in every bin of width ids that it reaches into, so the range condition
    becomes an equi-join on (symbol, bin) and a symbol's ids are spread over many tasks.
    """
    bin_of = lambda c: F.floor(c / width)
    nxt = F.col("last_update_id") + 1
    s = snapshots.select("symbol", "last_update_id", bin_of(nxt).alias("bin")).distinct()
    reach = F.sequence(bin_of(F.col("first_update_id")), bin_of(F.col("final_update_id")))
    e = events.where("first_update_id <= final_update_id").withColumn("bin", F.explode(reach))
    hit = e.join(s, ["symbol", "bin"]).where((F.col("first_update_id") <= nxt) & (F.col("final_update_id") >= nxt))
    return hit.groupBy("symbol", "last_update_id").agg(F.min_by("final_update_id", "seq").alias("bridge_id"), F.min("seq").alias("bridge_seq"))


def arrival_flags(events: DataFrame, hold_ms: int = 20, by: str = "symbol", width: int = 1 << 20) -> DataFrame:
    """Out-of-order and late flags against the largest time that arrived before; in blocks of width arrivals."""
    ts = F.greatest(F.col("ts_ms"), F.lit(0))
    d = running_max(events, ts, "max_seen", by=by, order="arrival_seq", width=width)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return d.withColumns({"out_of_order": flag(ts < F.col("max_seen")), "late": flag(ts < F.col("max_seen") - hold_ms)})


def latest(df: DataFrame, keys: list[str], version: Column | str) -> DataFrame:
    """The row of the highest version of each key, whole (columns of tied rows are not mixed)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return picked.select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first arrival of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return picked.select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def orphans(found: DataFrame, listed: DataFrame, key: str = "file_name") -> DataFrame:
    return found.join(listed, key, "left_anti")


def release_order(events: DataFrame, by: str = "symbol", block_ms: int = 3_600_000) -> DataFrame:
    """events (ts_ms, kind, arrival_seq) with their position: by time, trades before depth, then arrival; in time blocks."""
    first = F.when(F.col("kind") == "trade", 0).otherwise(1)
    return numbered(events, "position", by=by, order="ts_ms", ties=[first, "arrival_seq"], width=block_ms)
