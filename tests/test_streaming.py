"""Streaming equals batch, for any split of the files and after a restart."""

import random

import pytest

from lobspark.config import Settings
from lobspark.plans.replay import KERNEL_OUT, REPLAY_OUT, counters_of, keyframes_of, outputs, replay, signals_of
from lobspark.schemas import UNIFIED_EVENT
from lobspark.streaming.replay import stream_outputs, stream_signals


def events(n=120, seed=3):
    rng, out, last = random.Random(seed), [], {"A": 100, "B": 100}
    for sym in last:
        out.append(("snapshot", len(out), 0, 0, "x", "coinm", sym, None, 100, None, [(100.0, 2.0)], [(101.0, 2.0)], None, None, None))
    for i in range(n):
        sym, ts = rng.choice("AB"), 1000 + 40 * i + rng.randint(-30, 30)
        if rng.random() < 0.4:
            out.append(("trade", len(out), ts, ts, "x", "coinm", sym, None, None, None, None, None, 100.0, 1.0, rng.random() < 0.5))
        else:
            size = float(rng.randint(0, 5))
            out.append(("depth", len(out), ts, ts, "x", "coinm", sym, last[sym] + 1, last[sym] + 1, last[sym], [(99.0 + rng.randint(0, 1), size)], [(101.0, 3.0)], None, None, None))
            last[sym] += 1
    for sym in last:
        out.append(("end", len(out), None, None, "x", "coinm", sym, *[None] * 8))
    return out


def known(rows):
    return sorted((r["symbol"], r["event_id"], r["outcome"], r["cvd_5m"], r["best_bid"], r["m_ofi_top5"]) for r in rows)


@pytest.mark.parametrize("files", [1, 5])
def test_stream_is_batch(spark, tmp_path, files):
    rows = events()
    batch = replay(spark.createDataFrame(rows, UNIFIED_EVENT), Settings()).collect()
    src, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(files):  # each file is its own run: state survives a restart
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, UNIFIED_EVENT).coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema(UNIFIED_EVENT).parquet(str(src))
        q = stream_signals(s, Settings()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    assert known(spark.read.schema(REPLAY_OUT).parquet(out).collect()) == known(batch)


def test_outputs_of_stream_and_batch(spark, tmp_path):
    """Keyframes and counters leave the kernel in both; latency is told by the clock."""
    rows, s = events(), Settings(snapshot_dump_interval_secs=1)
    batch = outputs(spark.createDataFrame(rows, UNIFIED_EVENT), s)
    src = tmp_path / "in"
    spark.createDataFrame(rows, UNIFIED_EVENT).coalesce(1).write.parquet(str(src))
    stream = stream_outputs(spark.readStream.schema(UNIFIED_EVENT).parquet(str(src)), s, clock=lambda: 10_000_000.0)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.schema(KERNEL_OUT).parquet(str(tmp_path / "out"))
    for of in (keyframes_of, counters_of):
        assert sorted(map(str, of(got).collect())) == sorted(map(str, of(batch).collect())) and of(got).count()
    late = signals_of(got).select("ingest_to_signal_ms", "recv_ts_ms").collect()
    assert late and all(r["ingest_to_signal_ms"] == 10_000_000 - r["recv_ts_ms"] for r in late)
    assert signals_of(batch).where("ingest_to_signal_ms <> 0").count() == 0
