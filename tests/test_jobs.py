"""Streaming jobs end to end on files."""

import json

from lobspark.sources import archive
from lobspark.streaming import jobs


def test_frames_to_layers(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    trade = {"stream": "x@aggTrade", "data": {"e": "aggTrade", "E": 7, "T": 6, "s": "X", "a": 3, "p": "1.5", "q": "2", "f": 1, "l": 1, "m": True}}
    for i, frame in enumerate([trade, trade, {"x": 1}]):
        (src / f"{i}.txt").write_text(json.dumps([str(i), "100", json.dumps(frame)]) + "\n")
    beat = jobs.Heartbeat(warn=said.append if (said := []) is not None else None)
    spark.streams.addListener(beat)
    got = {}
    for name, df in jobs.layers(jobs.read_frames(spark, str(src), max_files=1)).items():
        q = df.writeStream.format("memory").queryName(f"layer_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got[name] = spark.table(f"layer_{name}").count()
    spark.streams.removeListener(beat)
    assert got == {"depth": 0, "trade": 2, "quote": 0, "bad": 1}
    beat.report(0.5, 10)
    beat.report(0.0, 61)
    assert len(said) == 2


def test_first_of_each_and_fan_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1000), ("a", 1000), ("b", 2000)], "event_id string, event_ts_ms long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.first_of_each(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    seen = []
    q = jobs.fan_out(stream, str(tmp_path / "cp"), lambda b, i: seen.append((i, b.count())), jobs.to_table(str(tmp_path / "out")))
    q.awaitTermination()
    assert sum(n for _, n in seen) == 2 and sorted({i for i, _ in seen}) == list(range(len({i for i, _ in seen})))
    out = str(tmp_path / "out")
    assert spark.read.parquet(out).count() == 2
    jobs.to_table(out)(rows.limit(1), seen[0][0])  # the same batch again
    jobs.to_table(out)(rows.limit(1), seen[0][0])
    assert spark.read.parquet(out).count() == 1 + sum(n for i, n in seen if i != seen[0][0])


def test_service_levels_are_reported(spark):
    said = []
    sink = jobs.service_levels(jobs.Heartbeat(warn=said.append))
    signals = [("emit", 5)] * 99 + [("resync", 900)]
    sink(spark.createDataFrame(signals, "outcome string, ingest_to_signal_ms long"), 0)
    sink(spark.createDataFrame([("emit", 5)] * 100, "outcome string, ingest_to_signal_ms long"), 1)
    sink(spark.createDataFrame([], "outcome string, ingest_to_signal_ms long"), 2)
    assert len(said) == 1 and "loss" in said[0]
    sink(spark.createDataFrame([("emit", 900)] * 3, "outcome string, ingest_to_signal_ms long"), 3)
    assert len(said) == 2 and "p99" in said[1]


def test_upsert_reads_the_batch_s_days(spark):
    spark.sql("drop table if exists upserted")
    spark.createDataFrame([("a", 1, "d1"), ("b", 1, "d2")], "k string, v long, day string").write.partitionBy("day").saveAsTable("upserted")
    sink = archive.upsert_batch("upserted", ["k", "day"], "day")
    batch = spark.createDataFrame([("a", 9, "d1"), ("c", 2, "d1"), ("c", 3, "d1")], "k string, v long, day string")
    for i in (0, 0):
        sink(batch, i)
    got = sorted((r["k"], r["v"] if r["k"] != "c" else 0) for r in spark.table("upserted").collect())
    assert got == [("a", 1), ("b", 1), ("c", 0)]
