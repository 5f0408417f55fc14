"""Telemetry counters, run gates and archive checks as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.functions.names import log_value, plain_log

#: Service levels.
MOST_LOSS, MOST_P99_MS = 0.0001, 60


def counters(events: DataFrame, kind: str = "kind") -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n"))


def loss_rate(events: DataFrame) -> DataFrame:
    """gaps / depth events by symbol, 0 where there are none (outcome column)."""
    n, gaps = F.count("*"), F.count(F.when(F.col("outcome") == "gap", 1))
    rate = F.when(n > 0, gaps / n).otherwise(0.0)
    return events.groupBy("symbol").agg(n.alias("depth_events"), gaps.alias("gap_events"), rate.alias("loss_rate"))


def telemetry(lines: DataFrame) -> DataFrame:
    """Log lines (profile, line_no, line) to the figures of each profile's last report."""
    clean = lines.withColumn("line", plain_log(F.col("line"))).where(F.col("line").contains("loss_rate="))
    last = clean.groupBy("profile").agg(F.max_by("line", "line_no").alias("line"))
    num = lambda k, t: log_value(F.col("line"), k).try_cast(t).alias(k)
    return last.select("profile", num("loss_rate", "double"), num("p99_ms", "double"), num("resync_started", "bigint"), num("resync_completed", "bigint"), num("signals_emitted", "bigint"))


def soak_gate(reports: DataFrame) -> DataFrame:
    """All profiles must pass all four tests; no report means a failed gate."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    d = reports.select(
        ok(F.col("loss_rate") <= MOST_LOSS).alias("loss_ok"), ok(F.col("p99_ms") <= MOST_P99_MS).alias("p99_ok"),
        ok(F.col("resync_started") == F.col("resync_completed")).alias("resync_ok"), ok(F.col("signals_emitted") > 0).alias("signals_ok"),
    )
    every = [F.coalesce(F.bool_and(c), F.lit(False)).alias(c) for c in d.columns]
    return d.agg(F.count("*").alias("profiles"), *every).withColumn("passed", F.col("loss_ok") & F.col("p99_ok") & F.col("resync_ok") & F.col("signals_ok"))


def archive_gate(files: DataFrame) -> DataFrame:
    """files (profile, file_name): each profile needs its three manifests, a part of each dataset and a metrics file."""
    has = lambda pattern: F.coalesce(F.bool_or(F.col("file_name").rlike(pattern)), F.lit(False))
    sets = ["bookticker", "depth-delta", "snapshot"]
    d = files.groupBy("profile").agg(
        *[has(rf"{s}.*manifest.*\.json$").alias(f"{s}_manifest") for s in sets], *[has(rf"^{s}.*part-\d+\.parquet$").alias(f"{s}_part") for s in sets], has(r"^metrics-.*\.jsonl$").alias("metrics")
    )
    passed = None
    for c in d.columns[1:]:
        passed = F.col(f"`{c}`") if passed is None else passed & F.col(f"`{c}`")
    return d.withColumn("passed", passed)


def upload_gate(lines: DataFrame) -> DataFrame:
    hit = lambda text: F.count_if(F.col("line").contains(text))
    d = lines.groupBy("profile").agg(hit("upload verified").alias("verified"), hit("upload failed").alias("failed"))
    return d.withColumn("passed", (F.col("verified") > 0) & (F.col("failed") == 0))
