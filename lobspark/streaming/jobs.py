"""Streaming jobs: frames in, raw layers and signals out, with a heartbeat."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lobspark.plans.gates import MOST_LOSS, MOST_P99_MS
from lobspark.sources import frames


def read_frames(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """Text files of (arrival_seq, recv_ts_ms, frame) JSON arrays; max_files a micro-batch holds back a flood."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    part = F.from_json("value", "array<string>")
    return lines.select(
        F.get(part, 0).cast("bigint").alias("arrival_seq"), F.get(part, 1).cast("bigint").alias("recv_ts_ms"), F.get(part, 2).alias("value")
    )


def layers(raw: DataFrame) -> dict[str, DataFrame]:
    """The decoded streams of raw frames, and those that could not be read."""
    routed = frames.route(raw)
    return {
        "depth": frames.decode_depth(routed), "trade": frames.decode_trades(routed), "quote": frames.decode_quotes(routed),
        "bad": routed.where(F.col("kind") == "bad").select("arrival_seq", "recv_ts_ms", "value"),
    }


def first_of_each(signals: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row an event id within the delay; bounded state."""
    timed = signals.withColumn("event_time", F.timestamp_millis("event_ts_ms"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("event_time")


def fan_out(signals: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Every micro-batch to several sinks, computed once. A sink gets the batch and its id; the id is
    the same when a batch is sent again after a failure, so a sink that keeps it repeats nothing.

    every: how often a batch is flushed ("500 milliseconds"); None takes what is there and ends.
    """

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    out = signals.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of Parquet folders by batch: a batch that comes again takes the place of its first try."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/p_batch={number}")

    return sink


def service_levels(beat: Heartbeat) -> Callable[[DataFrame, int], None]:
    """A sink of signals that has beat report each batch's share of broken chains and its 99th percentile of latency."""

    def sink(batch: DataFrame, _: int) -> None:
        broken = F.count(F.when(F.col("outcome") == "resync", 1))
        n, gaps, p99 = batch.agg(F.count("*"), broken, F.expr("percentile_disc(0.99) within group (order by ingest_to_signal_ms)")).first()
        if n:
            beat.report(gaps / n, float(p99 or 0))

    return sink


class Heartbeat(StreamingQueryListener):
    """Progress as a sign of life, and warnings where service levels are missed."""

    def __init__(self, warn: Callable[[str], None] = print, now: Callable[[], float] = time.time):
        self.warn, self.now = warn, now
        self.last: float | None = None
        self.rows = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.last = self.now()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.last = self.now()
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.last = self.now()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.warn(f"query ended: {event.exception}")

    def alive(self, within: float = 30.0) -> bool:
        return self.last is not None and self.now() - self.last <= within

    def report(self, loss: float, p99_ms: float) -> None:
        if loss > MOST_LOSS:
            self.warn(f"loss rate {loss:.6f} is over {MOST_LOSS}")
        if p99_ms > MOST_P99_MS:
            self.warn(f"p99 {p99_ms} ms is over {MOST_P99_MS} ms")
