"""Queries over the driver's tables, one for each group of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobspark.config import Settings
from lobspark.functions import names, signals
from lobspark.operators import book, sequence, windows
from lobspark.plans import gates, wire_queries
from lobspark.plans.replay import counters_of, keyframes_of, outputs, replay
from lobspark.plans.views import MONTH, deltas, quotes, table, trades, updates

HOUR = 3_600_000


def cvd_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.cvd(trades(spark, d), windows.CVD_WINDOWS | {"cvd_1h": HOUR})
    return out.select("symbol", "ts_ms", "trade_id", "cvd_5s", "cvd_1m", "cvd_5m", "cvd_1h")


def trade_buckets(spark: SparkSession, d: str) -> DataFrame:
    return windows.buckets(trades(spark, d), HOUR)


def trade_counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return gates.counters(trades(spark, d))


def latency_p99_nearest(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).withColumn("latency", F.col("qty"))
    return windows.nearest_rank(t, ["symbol"], "latency", ["trade_id"]).withColumnRenamed("p", "p99")


def loss_rate(spark: SparkSession, d: str) -> DataFrame:
    return gates.loss_rate(sequence.gaps(updates(spark, d)))


def book_lww(spark: SparkSession, d: str) -> DataFrame:
    return book.last_write(deltas(spark, d))


def book_best(spark: SparkSession, d: str) -> DataFrame:
    return book.best(book.last_write(deltas(spark, d)))


def book_topn(spark: SparkSession, d: str) -> DataFrame:
    return book.top(book.last_write(deltas(spark, d)), 5).select("symbol", "is_bid", "level", "price", "size")


def book_full(spark: SparkSession, d: str) -> DataFrame:
    b = book.full(book.last_write(deltas(spark, d)))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", (x["price"] * 2).cast("long"), x["size"].cast("long"))), ",")
    return b.select("symbol", text("bids").alias("bids"), text("asks").alias("asks"))


def book_asof(spark: SparkSession, d: str) -> DataFrame:
    return book.as_of(deltas(spark, d), F.lit(9800 * 100_000_000_000))


def _year_marks(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each symbol and year-long bucket of days."""
    return deltas(spark, d).groupBy("symbol", F.floor(F.col("day") / 365).alias("bucket")).agg(F.max("seq").alias("seq"))


def keyframe_daily(spark: SparkSession, d: str) -> DataFrame:
    at = book.at_marks(deltas(spark, d), _year_marks(spark, d), "bucket", width=MONTH)
    side = lambda flag: F.count(F.when(flag, 1))
    bid = F.col("is_bid")
    return at.groupBy("symbol", "bucket").agg(side(bid).alias("bids"), side(~bid).alias("asks"), F.sum(F.when(bid, F.col("size")).otherwise(0.0)).alias("bid_size"))


def depth_changes(spark: SparkSession, d: str) -> DataFrame:
    c = book.changes(deltas(spark, d))
    return c.groupBy("symbol", "is_bid", "change").agg(F.count("*").alias("n"), F.sum("drop").alias("dropped"))


def band_notional_linear(spark: SparkSession, d: str) -> DataFrame:
    return book.band_notional(book.last_write(deltas(spark, d)), "linear")


def band_notional_inverse(spark: SparkSession, d: str) -> DataFrame:
    return book.band_notional(book.last_write(deltas(spark, d)), "inverse", 100.0)


def quote_spread_micro(spark: SparkSession, d: str) -> DataFrame:
    b, a, bq, aq = (F.col(c) for c in ("bid", "ask", "bid_qty", "ask_qty"))
    q = quotes(spark, d).where((b > 0) & (a > 0))
    return q.select(
        "symbol", "seq", signals.mid(b, a).alias("mid_price"), F.round(signals.spread_bps(b, a), 6).alias("spread_bps"),
        F.round(signals.microprice(b, bq, a, aq), 6).alias("microprice"),
    )


def imbalance(spark: SparkSession, d: str) -> DataFrame:
    n = book.band_notional(book.last_write(deltas(spark, d)), "linear")
    return n.select("symbol", F.round(signals.share(F.col("bid_notional"), F.col("ask_notional")), 9).alias("imbalance"))


def ofi_l1(spark: SparkSession, d: str) -> DataFrame:
    names_ = ["bid", "bid_qty", "ask", "ask_qty"]
    q = windows.lagged(quotes(spark, d), names_, "was", by="symbol", order="seq", width=1 << 20)
    return q.select("symbol", "seq", signals.ofi_l1(*[F.col(c) for c in names_], *[F.col(f"was.{c}") for c in names_]).alias("ofi_l1"))


def m_ofi_top5(spark: SparkSession, d: str) -> DataFrame:
    at = book.at_marks(deltas(spark, d), _year_marks(spark, d), "bucket", width=MONTH)
    top = book.top(at, 5, ("symbol", "bucket"))
    depth = lambda flag: F.sum(F.when(flag, F.col("size")).otherwise(0.0))
    sums = top.groupBy("symbol", "bucket").agg(depth(F.col("is_bid")).alias("b"), depth(~F.col("is_bid")).alias("a"))
    w = Window.partitionBy("symbol").orderBy("bucket")
    flow = signals.m_ofi(F.col("b"), F.col("a"), F.lag("b", 1, 0.0).over(w), F.lag("a", 1, 0.0).over(w))
    return sums.select("symbol", "bucket", flow.alias("m_ofi_top5"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return deltas(spark, d).withColumn("ts_ms", F.col("day") * 86_400_000)


def level_stats_mu2sigma(spark: SparkSession, d: str) -> DataFrame:
    s = windows.level_stats(_samples(spark, d), 90 * 86_400_000)
    return s.select("symbol", "is_bid", "price", "seq", "n_samples", F.round("threshold", 6).alias("threshold"))


def wall_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = book.changes(deltas(spark, d)).withColumn("ts_ms", F.col("day") * 86_400_000)
    n, mean, sigma = windows.moments(F.col("was"), ["symbol", "is_bid", "price", "__block"], "ts_ms", 90 * 86_400_000, 86_400_000)
    s = windows.in_blocks(s, "ts_ms", 90 * 86_400_000, 64 * 90 * 86_400_000)
    s = s.withColumns({"n": n, "limit": mean + 2 * sigma}).where("__own").where("n >= 2 and drop > 0 and was >= limit and drop >= 0.8 * was and limit > 0")
    score = signals.wall_score(F.col("was"), F.col("drop"), F.col("limit"), F.lit(1.0), F.lit(0.0))
    s = s.withColumn("score", F.round(score, 6))
    best = Window.partitionBy("symbol", "day").orderBy(F.desc("score"), F.desc("is_bid"), "price", "seq")
    return s.withColumn("r", F.row_number().over(best)).where("r = 1").select("symbol", "day", "is_bid", "price", "seq", "score")


def wall_alignment(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).withColumn("reason", F.when(F.col("is_bid"), "bid_wall_cancel_after_buy_sweep").otherwise("ask_wall_cancel_after_sell_sweep"))
    flow = F.col("qty") - 25
    return t.select("trade_id", signals.aligned(F.col("reason"), flow).alias("kept"))


def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return sequence.latest(t, ["user_id", "event_type"], "event_id")


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return sequence.first_seen(t, ["user_id", "event_type"], "event_id")


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = sequence.gaps(updates(spark, d))
    return g.select("symbol", "seq", F.coalesce("prev_seen", F.lit(-1)).alias("prev_seen"), "outcome")


def bridge_event(spark: SparkSession, d: str) -> DataFrame:
    u = updates(spark, d)
    snaps = u.select("symbol", (F.col("final_update_id") - F.col("seq") % 23).alias("last_update_id"))
    return sequence.bridge(u, snaps)


def orphan_parts(spark: SparkSession, d: str) -> DataFrame:
    name = names.part_name("depth-delta", F.lit(0).cast("long"), F.lit("x"), F.lit("y"), F.col("p_partkey"))
    found = table(spark, d, "part").select(name.alias("file_name"), F.col("p_partkey").alias("part_index"))
    listed = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("part_index"))
    return sequence.orphans(found, listed, "part_index").select("file_name", "part_index")


def next_part_index(spark: SparkSession, d: str) -> DataFrame:
    o = orphan_parts(spark, d)
    return o.agg(F.count("*").alias("orphans"), (F.coalesce(F.max(names.part_index(F.col("file_name"))), F.lit(0)) + 1).alias("next_index"))


def out_of_order_flags(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).withColumn("arrival_seq", F.col("trade_id") + F.col("user_id") % 5)
    t = t.withColumn("arrival_seq", F.col("arrival_seq") * 10_000_000 + F.col("trade_id"))
    f = sequence.arrival_flags(t, HOUR // 6, width=10_000_000 << 12)
    return f.select("symbol", "trade_id", "out_of_order", "late")


def alarm_m_of_n(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).withColumn("bad", (F.col("kind") == "error").cast("long"))
    return windows.m_of_n(t, ts="ts_ms", value="bad", by=["symbol"], period_ms=HOUR, limit=1)


def counter_increases(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d).withColumn("counter", F.col("seq") % 1000)
    return q.select("symbol", "seq", windows.counter_increase(q, "counter", ["symbol"], "seq").alias("gained"))


def gate_all_pass(spark: SparkSession, d: str) -> DataFrame:
    reports = trades(spark, d).groupBy("symbol").agg(
        F.lit(0.0).alias("loss_rate"), F.max_by("qty", "trade_id").alias("p99_ms"), F.lit(1).alias("resync_started"),
        F.lit(1).alias("resync_completed"), F.count("*").alias("signals_emitted"),
    )
    return gates.soak_gate(reports)


def daily_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).groupBy("symbol", names.date_key(F.col("ts_ms")).alias("date")).agg(F.count("*").alias("n"))


def partition_value_norm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    value = names.partition_value(F.concat(F.lit(" "), F.col("p_name"), F.lit("/"), F.col("p_brand")))
    file = names.part_name("bookticker", F.col("p_partkey") * 1000, F.lit("binance"), value, F.col("p_partkey"))
    return p.select("p_partkey", value.alias("value"), file.alias("file_name"), names.part_index(file).alias("part_index"))


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a\\b/"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    return p.select("p_partkey", names.object_key(F.lit("raw/"), F.lit("binance"), F.lit("btcusdt"), F.lit("2026-04-16"), name).alias("object_key"))


def event_ids(spark: SparkSession, d: str) -> DataFrame:
    u = updates(spark, d)
    key = signals.event_id(F.lit("binance"), F.lit("coinm"), F.col("symbol"), F.col("final_update_id"))
    followed = signals.followed_id(F.when(F.col("seq") % 3 > 0, F.col("prev_final_update_id")), F.col("first_update_id"))
    return u.select("seq", key.alias("event_id"), followed.alias("depth_update_pu"))


def clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d)
    offset = names.clock_offset(F.col("seq"), F.col("seq") + F.col("o_custkey") % 9, F.col("seq") + 3, F.col("seq") + F.col("o_custkey") % 17)
    return q.select("seq", offset.alias("offset_ms"), names.received_at(F.col("seq"), offset, F.col("seq") + 1).alias("recv_ms"))


def clock_slew_fold(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    m = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", F.floor("c_acctbal").cast("bigint").alias("m")))), lambda x: x["m"])
    return c.groupBy("c_nationkey").agg(names.slew(m, alpha=0.5, step=25).alias("offset_ms"))


def fifo_queue_closed_form(spark: SparkSession, d: str) -> DataFrame:
    c = book.changes(deltas(spark, d))
    adds = c.where("change in ('add', 'increase')").select(*book.KEYS, "seq", (F.col("size") - F.col("was")).alias("size"))
    gone = c.groupBy(*book.KEYS).agg(F.sum("drop").alias("removed"))
    return book.fifo_left(adds, gone).where("left > 0").select(*book.KEYS, "seq", "left")


def counts_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))


def _kernel_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as depth events, each followed by a trade; thirty days are a stretch of a symbol."""
    q = quotes(spark, d).withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")))
    level = lambda p, s: F.struct(F.round(p, 2).alias("price"), s.alias("size"))
    base = q.withColumn("rn", F.row_number().over(Window.partitionBy("symbol", F.floor(F.col("day") / 30)).orderBy("day", "seq")).cast("long"))
    price = lambda off: 100.0 + F.lit(off) + F.col("seq") % 5 * 0.5
    none = F.lit(None)
    ev = base.select(
        F.when(F.col("rn") == 1, "snapshot").otherwise("depth").alias("kind"), (F.col("rn") * 2).alias("arrival_seq"), (F.col("rn") * 100).alias("recv_ts_ms"),
        (F.col("rn") * 100).alias("event_ts_ms"), F.lit("binance").alias("exchange"), F.lit("coinm").alias("market"), "symbol",
        (F.col("rn") * 10 - 9).alias("first_update_id"), (F.col("rn") * 10).alias("final_update_id"), (F.col("rn") * 10 - 10).alias("prev_final_update_id"),
        F.array(level(price(-5), F.col("bid_qty"))).alias("bids"), F.array(level(price(5), F.col("ask_qty"))).alias("asks"),
        none.cast("double").alias("price"), none.cast("double").alias("qty"), none.cast("boolean").alias("buyer_is_maker"),
        F.floor(F.col("day") / 30).alias("epoch"),
    )
    tr = base.select(
        F.lit("trade").alias("kind"), (F.col("rn") * 2 + 1).alias("arrival_seq"), (F.col("rn") * 100 + 50).alias("recv_ts_ms"), (F.col("rn") * 100 + 50).alias("event_ts_ms"),
        F.lit("binance").alias("exchange"), F.lit("coinm").alias("market"), "symbol", *[none.cast("long").alias(c) for c in ("first_update_id", "final_update_id", "prev_final_update_id")],
        none.cast(ev.schema["bids"].dataType).alias("bids"), none.cast(ev.schema["asks"].dataType).alias("asks"), price(-5).alias("price"),
        F.lit(1.0).alias("qty"), (F.col("seq") % 2 == 0).alias("buyer_is_maker"), F.floor(F.col("day") / 30).alias("epoch"),
    )
    return ev.union(tr)


def kernel_replay(spark: SparkSession, d: str) -> DataFrame:
    """All signal columns of the ordered kernel."""
    return replay(_kernel_events(spark, d), Settings(), epoch="epoch")


def kernel_book(spark: SparkSession, d: str) -> DataFrame:
    """The kernel's signals without those of queues and walls, which SQL can't state."""
    r = replay(_kernel_events(spark, d), Settings(), epoch="epoch")
    return r.select(
        "symbol", "event_id", "event_ts_ms", "depth_update_u", "depth_update_pu", "stale_state", "outcome", "best_bid", "best_ask", "mid_price",
        F.round("spread_bps", 6).alias("spread_bps"), F.round("microprice", 6).alias("microprice"), "bid_notional_5pct", "ask_notional_5pct",
        F.round("imbalance_5pct", 9).alias("imbalance_5pct"), "ofi_l1", "m_ofi_top5", "cvd_5s", "cvd_1m", "cvd_5m", "ingest_to_signal_ms",
    )


def kernel_counters(spark: SparkSession, d: str) -> DataFrame:
    return counters_of(outputs(_kernel_events(spark, d), Settings(), epoch="epoch"))


def kernel_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes a second, by what they hold."""
    k = keyframes_of(outputs(_kernel_events(spark, d), Settings(snapshot_dump_interval_secs=1), epoch="epoch"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["size"])
    return k.select(
        "symbol", "snapshot_ts_ms", "last_update_id", "snapshot_source", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"),
        total("bids").alias("bid_size"), total("asks").alias("ask_size"), F.get("bids", F.lit(0))["price"].alias("best_bid"), F.get("asks", F.lit(0))["price"].alias("best_ask"),
    )


def crossed_books(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and years whose live book is crossed or locked."""
    b = book.best(book.at_marks(deltas(spark, d), _year_marks(spark, d), "bucket", width=MONTH).withColumn("symbol", F.concat_ws("/", "symbol", "bucket")))
    return b.select("symbol", "best_bid", "best_ask", F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False)).alias("crossed"))




QUERIES = {
    f.__name__: f
    for f in (
        cvd_windows, trade_buckets, trade_counts_by_kind, latency_p99_nearest, loss_rate, book_lww, book_best, book_topn, book_full, book_asof,
        keyframe_daily, depth_changes, band_notional_linear, band_notional_inverse, quote_spread_micro, imbalance, ofi_l1, m_ofi_top5,
        level_stats_mu2sigma, wall_candidates, wall_alignment, dedup_latest, dedup_first, sequence_gaps, bridge_event, orphan_parts,
        next_part_index, out_of_order_flags, alarm_m_of_n, counter_increases, gate_all_pass, daily_partition_counts, partition_value_norm,
        object_keys, event_ids, clock_offsets, clock_slew_fold, fifo_queue_closed_form, counts_by_symbol, kernel_replay,
        kernel_book, kernel_counters, kernel_keyframes, crossed_books,
    )
} | wire_queries.QUERIES
