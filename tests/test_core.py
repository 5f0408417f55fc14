"""Expressions, decoders, archive, gates and configuration."""

import json
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lobspark.config import Settings
from lobspark.functions import names
from lobspark.operators import book, sequence, windows
from lobspark.plans import gates
from lobspark.schemas import DEPTH_DELTA, contract_errors
from lobspark.sources import archive, feed, frames, legacy


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_settings(tmp_path):
    s = Settings.from_env({"APP_MARKET": "usd-m", "APP_SYMBOL": "btcusdt", "APP_DEPTH_LIMIT": "50", "OTHER": "x"})
    assert (s.market, s.symbol, s.contract, s.depth_limit, s.overlap_allowed) == ("usdm", "BTCUSDT", "linear", 50, False)
    assert Settings().contract == "inverse" and Settings(cancel_heuristic="pro-rata").cancel_heuristic == "prorata"
    (tmp_path / "p").write_text("# profile\nAPP_MARKET=spot\nAPP_SYMBOL='ethusd'\n")
    assert Settings.from_file(str(tmp_path / "p")).overlap_allowed
    for bad in ({"market": "x"}, {"contract": "x"}, {"depth_limit": 0}, {"exchange": " "}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_names(spark):
    assert one(spark, names.part_name("bookticker", F.lit(1763000000000), F.lit("binance"), F.lit("btcusd_perp"), F.lit(7))) == (
        "bookticker_1763000000000_binance_btcusd_perp_part-000007.parquet"
    )
    for name, index in (("a_part-000042.parquet", 42), ("bookticker-2026-04-14-part-000042.parquet", 42), ("a_part-000001.tmp.parquet", None)):
        assert one(spark, names.part_index(F.lit(name))) == index
    assert one(spark, names.partition_value(F.lit(" BTC/USD "))) == "btc_usd" and one(spark, names.partition_value(F.lit("  "))) == "unknown"
    for stem in ("metrics-binance-usdm-btcusdt-2026-04-16", "metrics-2026-04-16"):
        assert one(spark, names.metrics_file_date(F.lit(stem))) == date(2026, 4, 16)
    assert one(spark, names.log_value(names.plain_log(F.lit("\x1b[32mINFO\x1b[0m p99=Some(7) x=1")), "p99")) == "7"
    assert one(spark, names.clock_offset(F.lit(0), F.lit(-3), F.lit(0), F.lit(0))) == -1
    assert one(spark, names.slew(F.array(F.lit(300).cast("bigint")))) == 25
    assert one(spark, names.slew(F.array(*[F.lit(300).cast("bigint")] * 2))) == 50
    assert one(spark, names.slew(F.array(F.lit(-100).cast("bigint")), start=100, alpha=1.0, step=30)) == 70


def test_frames(spark):
    rows = [
        {"stream": "btcusd_perp@depth@100ms", "data": {"e": "depthUpdate", "E": 5, "T": 4, "s": "BTCUSD_PERP", "ps": "BTCUSD", "U": 1, "u": 2, "pu": 0, "b": [["1.5", "2"], ["x", "1"]], "a": [["2", "0"]]}},
        {"stream": "btcusd@bookTicker", "data": {"u": 9, "s": "btcusd", "b": "1", "B": "2", "a": "3", "A": "4"}},
        {"stream": "btcusd@aggTrade", "data": {"e": "aggTrade", "E": 7, "T": 6, "s": "BTCUSD", "a": 3, "p": "1.25", "q": "2", "f": 1, "l": 1, "m": True}},
        {"stream": "btcusd@aggTrade", "data": {"e": "aggTrade", "E": 7, "s": "BTCUSD", "a": 4, "p": "bad", "q": "2", "m": True}},
    ]
    raw = spark.createDataFrame([(i, 100, json.dumps(r)) for i, r in enumerate(rows)] + [(9, 100, "{broken")], "arrival_seq long, recv_ts_ms long, value string")
    routed = frames.route(raw).cache()
    assert {r["kind"]: r["count"] for r in routed.groupBy("kind").count().collect()} == {"depth": 1, "quote": 1, "trade": 2, "bad": 1}
    d = frames.decode_depth(routed)
    r = d.first()
    assert (r["event_ts_ms"], r["first_update_id"], r["final_update_id"], r["prev_final_update_id"], r["pair"]) == (5, 1, 2, 0, "BTCUSD")
    deltas = frames.delta_rows(d.withColumns({"exchange": F.lit("binance"), "market": F.lit("coinm")}))
    assert [(x["is_bid"], x["price"], x["size"]) for x in deltas.collect()] == [(True, 1.5, 2.0), (False, 2.0, 0.0)]
    assert contract_errors(deltas.schema, DEPTH_DELTA) == []
    q = frames.decode_quotes(routed).first()
    assert (q["event_ts_ms"], q["update_id"], q["bid"], q["ask_qty"]) == (100, 9, 1.0, 4.0)
    assert [t["trade_id"] for t in frames.decode_trades(routed).collect()] == [3]
    snap = spark.createDataFrame([('{"lastUpdateId": 5, "bids": [["1", "0"], ["-1", "2"]], "asks": []}',)], "value string")
    assert [tuple(x) for x in frames.decode_snapshots(snap).first()["bids"]] == [(1.0, 0.0)]
    assert frames.stream_path("x", quotes=False) == "x@depth@100ms/x@aggTrade"
    with pytest.raises(ValueError):
        frames.stream_path("x", depth=False, quotes=False, trades=False)


def test_concatenated_lines(spark, tmp_path):
    row = lambda ts: json.dumps({"schema_version": 1, "symbol": "X", "event_ts_ms": ts, "recv_ts_ms": ts, "raw_json": "{}"})
    (tmp_path / "a.jsonl").write_text(f"{row(10)}{row(11)}\n\nnot-json\n{row(12)} tail\n")
    got = legacy.read_concatenated(spark, str(tmp_path)).collect()
    assert sorted(r["event_ts_ms"] for r in got if not r["bad"]) == [10, 11] and sum(r["bad"] for r in got) == 2


def test_feed(spark, tmp_path):
    assert list(feed.back_off(4, most=4, jitter_bps=0)) == [1, 2, 4, 4] and list(feed.back_off(1, first=0.01)) == [0.1]
    (tmp_path / "f").write_text("".join(json.dumps([i, "{}"]) + "\n" for i in range(5)))
    (tmp_path / "f.snapshot").write_text("{}")
    c = feed.connector("replay", path=str(tmp_path / "f"))
    assert [x[0] for x in c.frames(2, 2)] == [2, 3] and feed.fetch_snapshot(c, "x") == "{}"
    with pytest.raises(ValueError):
        feed.connector("nowhere")
    spark.dataSource.register(feed.FrameSource)
    q = spark.readStream.format("lob_frames").option("path", str(tmp_path / "f")).load().writeStream.format("memory").queryName("frames").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("frames").count() == 5


def test_archive(spark, tmp_path):
    rows = [(86_400_000 * d, 86_400_000 * d, "binance", "coinm", "BTC/X", True, 1.0, 1.0, 1, 1, 1) for d in (0, 1)]
    df = spark.createDataFrame(rows, DEPTH_DELTA)
    path = str(tmp_path / "lake")
    archive.write(df, path, "recv_ts_ms")
    back = spark.read.parquet(path)
    assert {r["p_date"].isoformat() for r in back.select("p_date").collect()} == {"1970-01-01", "1970-01-02"} and back.first()["p_symbol"] == "btc_x"
    assert archive.prune(spark, path, date(1970, 1, 3), 1) == ["p_date=1970-01-01"]
    assert {r["p_date"].isoformat() for r in spark.read.parquet(path).select("p_date").collect()} == {"1970-01-02"}
    day = tmp_path / "day"
    day.mkdir()
    for i in (1, 2):
        spark.range(i).toPandas().to_parquet(day / f"depth-delta_0_binance_x_part-{i:06d}.parquet")
    (day / "depth-delta_0_binance_x_part-000003.tmp.parquet").write_text("unfinished")
    found = archive.parts(spark, str(day), "depth-delta")
    assert [r["part_index"] for r in found.collect()] == [1, 2]
    manifest = str(tmp_path / "m.json")
    assert archive.read_manifest(spark, manifest) is None
    archive.save_manifest(spark, manifest, "1970-01-01", archive.reconcile(found, None).where("part_index = 1"))
    assert json.loads((tmp_path / "m.json").read_text())["next_part_index"] == 2
    assert archive.reconcile(found, archive.read_manifest(spark, manifest)).count() == 2
    out = str(tmp_path / "out")
    assert archive.upload_day(spark, str(day), manifest, "depth-delta", "1970-01-01", out) == 2
    assert archive.upload_day(spark, str(day), manifest, "depth-delta", "1970-01-01", out, delete=True) == 0
    assert archive.parts(spark, out, "depth-delta").count() == 2 and not list(day.glob("*part-00000[12].parquet"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        archive.read_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_tables(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "event_id string, recv_ts_ms long, v double").withColumn("symbol", F.lit("s"))
    assert {r["event_id"]: r["v"] for r in archive.deduplicated(df).collect()} == {"a": 2.0, "b": 3.0}
    assert {r["event_id"]: r["v"] for r in archive.first_only(df).collect()} == {"a": 1.0, "b": 3.0}
    archive.create_table(spark, "signals_t", df.drop("v"))
    archive.create_table(spark, "signals_t", df)
    assert "v" in spark.table("signals_t").columns
    sink = archive.upsert_batch("signals_t", ["event_id"])
    sink(df.select(spark.table("signals_t").columns), 0)
    sink(df.select(spark.table("signals_t").columns), 1)
    assert spark.table("signals_t").count() == 2
    with pytest.raises(ValueError):
        archive.create_table(spark, "bad-name", df)
    assert contract_errors(df.schema, df.drop("v").schema) == [] and len(contract_errors(df.drop("v").schema, df.schema)) == 1


@pytest.mark.parametrize(("n", "want"), [(1, 0), (2, 1), (100, 98), (101, 99), (20_500, 500 + 19_799)])
def test_nearest_rank(spark, n, want):
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.col("id").alias("v"), F.col("id").alias("seq"))
    assert windows.nearest_rank(df, ["symbol"], "v", ["seq"]).first()["p"] == want


def test_gates(spark):
    lines = [("a", 1, "loss_rate=0.5 p99_ms=9"), ("a", 2, "\x1b[1mreport\x1b[0m loss_rate=0.0 p99_ms=Some(60) resync_started=1 resync_completed=1 signals_emitted=4")]
    t = gates.telemetry(spark.createDataFrame(lines, "profile string, line_no int, line string"))
    assert gates.soak_gate(t).first()["passed"] and not gates.soak_gate(t.where("false")).first()["passed"]
    names_ = [f"{s}{x}" for s in ("bookticker", "depth-delta", "snapshot") for x in ("-manifest.json", "_1_x_y_part-000001.parquet")]
    files = spark.createDataFrame([("a", n) for n in [*names_, "metrics-2026-04-16.jsonl"]] + [("b", n) for n in names_], "profile string, file_name string")
    assert {r["profile"]: r["passed"] for r in gates.archive_gate(files).collect()} == {"a": True, "b": False}
    up = spark.createDataFrame([("a", "upload verified x"), ("b", "upload failed y")], "profile string, line string")
    assert {r["profile"]: r["passed"] for r in gates.upload_gate(up).collect()} == {"a": True, "b": False}


def test_time_blocks_change_no_window(spark):
    rows = [("A", i * 700 % 9000, i % 3 == 0, float(i % 5), i) for i in range(60)] + [("B", -50, True, 1.0, 99)]
    t = spark.createDataFrame(rows, "symbol string, ts_ms long, buyer_is_maker boolean, qty double, trade_id long")
    few = windows.cvd(t, {"w": 1000}, block_ms=1000).orderBy("trade_id").collect()
    assert few == windows.cvd(t, {"w": 1000}, block_ms=10**9).orderBy("trade_id").collect()
    signed = [(s, ts, -q if m else q, i) for s, ts, m, q, i in rows]
    want = {i: sum(q for s2, t2, q, _ in signed if s2 == s and ts - 1000 <= t2 <= ts) for s, ts, _, i in signed}
    assert {r["trade_id"]: r["w"] for r in few} == want


def test_a_block_must_hold_the_reach(spark):
    with pytest.raises(ValueError):
        windows.in_blocks(spark.range(1).withColumnRenamed("id", "ts_ms"), "ts_ms", 10, 5)


def test_bridge_bins_find_what_the_range_finds(spark):
    ev = [("A", i, 10 * i - 9, 10 * i, 10 * i - 10) for i in range(1, 30)] + [("A", 31, 1, 500, 0)]
    e = spark.createDataFrame(ev, "symbol string, seq long, first_update_id long, final_update_id long, prev_final_update_id long")
    s = spark.createDataFrame([("A", x) for x in (0, 9, 10, 155, 499, 500, 900)], "symbol string, last_update_id long")
    want = {}
    for x in (0, 9, 10, 155, 499, 500, 900):
        hits = [(q, z) for _, q, a, z, _ in ev if a <= x + 1 <= z]
        if hits:
            want[x] = min(hits)[::-1]
    for width in (7, 64, 1024):
        got = {r["last_update_id"]: (r["bridge_id"], r["bridge_seq"]) for r in sequence.bridge(e, s, width).collect()}
        assert got == want


def test_attribution_uses_trades_up_in_order(spark):
    d = spark.createDataFrame([("A", True, 1.0, 0, 1, 4.0), ("A", True, 1.0, 0, 2, 4.0), ("A", True, 1.0, 0, 3, 1.0), ("A", False, 1.0, 0, 4, 2.0)], "symbol string, is_bid boolean, price double, bucket long, seq long, drop double")
    t = spark.createDataFrame([("A", True, 1.0, 0, 6.0)], "symbol string, is_bid boolean, price double, bucket long, traded double")
    got = {r["seq"]: (r["executed"], r["cancelled"]) for r in book.attribute(d, t).collect()}
    assert got == {1: (4.0, 0.0), 2: (2.0, 2.0), 3: (0.0, 1.0), 4: (0.0, 2.0)}


def test_blocks_change_nothing(spark):
    """Lags, running maxima and places in blocks are those of one window a key, for any width."""
    import random

    rng = random.Random(3)
    order = rng.sample(range(-500, 4000), 300)
    rows = [(rng.choice(["a", "b", None]), o, rng.randrange(50), rng.randrange(9)) for o in order]
    d = spark.createDataFrame(rows, "symbol string, seq long, v long, w long")
    by = Window.partitionBy("symbol").orderBy("seq")
    want = d.withColumns({"was": F.lag("v").over(by), "top": F.max("v").over(by.rowsBetween(Window.unboundedPreceding, -1))})
    places = d.withColumn("at", F.row_number().over(Window.partitionBy("symbol").orderBy("v", "w", "seq")))
    key = lambda x: sorted(map(str, x.collect()))
    for width in (1, 7, 100, 10**6):
        got = windows.lagged(d, ["v"], "was", by="symbol", order="seq", width=width).withColumn("was", F.col("was.v"))
        got = windows.running_max(got, F.col("v"), "top", by="symbol", order="seq", width=width)
        assert key(got) == key(want)
        assert key(windows.numbered(d, "at", by="symbol", order="v", ties=["w", "seq"], width=min(width, 10))) == key(places)
