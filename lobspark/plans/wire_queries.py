"""Queries on frames, archives, gates and attribution; their SQL is in plans/oracle.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.functions import names, signals
from lobspark.operators import book, sequence, windows
from lobspark.plans import gates
from lobspark.plans.views import MONTH, deltas, quotes, table, trades
from lobspark.sources import archive, frames, legacy

DAY_MS = 86_400_000


def _frame(stream: Column, **data: Column) -> Column:
    """A combined-stream envelope as JSON text; null members are left out."""
    inner = F.struct(*[v.alias(k) for k, v in data.items()])
    return F.to_json(F.struct(stream.alias("stream"), inner.alias("data")))


def frame_routes(spark: SparkSession, d: str) -> DataFrame:
    """All four ways a frame is recognised or not: by type, by stream name, neither, no envelope."""
    t, pick = trades(spark, d), F.col("trade_id") % 5
    stream = F.lower(F.concat("symbol", F.when(pick == 0, "@depth@100ms").when(pick == 1, "@bookTicker").when(pick == 2, "@aggTrade").otherwise("@other")))
    event = F.when(pick == 0, "depthUpdate").when(pick == 2, "aggTrade")
    value = F.when(pick == 4, F.lit("not an envelope")).otherwise(_frame(stream, e=event, a=F.col("trade_id")))
    return frames.route(t.select("trade_id", value.alias("value"))).select("trade_id", "kind")


def trade_frames(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    qty = F.when(F.col("kind") == "error", "not a number").otherwise(F.col("qty").cast("string"))
    value = _frame(
        F.concat(F.lower("symbol"), F.lit("@aggTrade")), e=F.lit("aggTrade"), E=F.col("ts_ms"), T=F.col("ts_ms"), s=F.col("symbol"),
        a=F.col("trade_id"), p=F.col("price").cast("string"), q=qty, m=F.col("buyer_is_maker"),
    )
    read = frames.decode_trades(frames.route(t.select(F.col("ts_ms").alias("recv_ts_ms"), value.alias("value"))))
    return read.select("symbol", "trade_id", "event_ts_ms", "price", "qty", "buyer_is_maker")


def quote_frames(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d).withColumn("recv_ts_ms", F.col("seq") * 10)
    value = _frame(
        F.concat(F.lower("symbol"), F.lit("@bookTicker")), E=F.when(F.col("seq") % 2 == 1, F.col("seq") * 10 - 3), s=F.col("symbol"), u=F.col("seq"),
        b=F.col("bid").cast("string"), B=F.col("bid_qty").cast("string"), a=F.col("ask").cast("string"), A=F.col("ask_qty").cast("string"),
    )
    read = frames.decode_quotes(frames.route(q.select("recv_ts_ms", value.alias("value"))))
    return read.select("symbol", "update_id", "event_ts_ms", "bid", "bid_qty", "ask", "ask_qty")


def _pair(price: Column | str, size: Column | str) -> Column:
    return F.array(F.lit(price) if isinstance(price, str) else price.cast("string"), F.lit(size) if isinstance(size, str) else size.cast("string"))


def depth_frames(spark: SparkSession, d: str) -> DataFrame:
    """Depth frames to archive rows: bad prices and sizes are skipped, deletions stay."""
    q = quotes(spark, d)
    value = _frame(
        F.concat(F.lower("symbol"), F.lit("@depth@100ms")), e=F.lit("depthUpdate"), E=F.col("seq"), s=F.col("symbol"), U=F.col("seq") * 10 - 9, u=F.col("seq") * 10,
        b=F.array(_pair(F.col("bid"), F.col("bid_qty")), _pair("-1", "5")), a=F.array(_pair(F.col("ask"), F.col("ask_qty")), _pair("x", "1"), _pair(F.col("ask") + 1, "0")),
    )
    read = frames.decode_depth(frames.route(q.select(F.col("seq").alias("recv_ts_ms"), value.alias("value"))))
    rows = frames.delta_rows(read.withColumns({"exchange": F.lit("binance"), "market": F.lit("coinm")}))
    return rows.select("symbol", "is_bid", "price", "size", "first_update_id", "final_update_id")


def snapshot_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot bodies to archive rows of parallel arrays; sizes of 0 survive here and go when loaded."""
    q = quotes(spark, d)
    body = F.to_json(F.struct(
        F.col("seq").alias("lastUpdateId"), F.array(_pair(F.col("bid"), F.col("bid_qty")), _pair(F.col("bid") - 1, "0"), _pair("0", "7")).alias("bids"),
        F.array(_pair(F.col("ask"), F.col("ask_qty"))).alias("asks"),
    ))
    fixed = {"snapshot_ts_ms": F.lit(0), "exchange": F.lit("binance"), "market": F.lit("coinm"), "snapshot_source": F.lit("rest")}
    s = frames.decode_snapshots(q.select("symbol", body.alias("value"))).withColumns(fixed)
    loaded = book.load_snapshot(s).groupBy("seq").agg(F.count("*").alias("n_loaded")).withColumnRenamed("seq", "last_update_id")
    rows = frames.snapshot_rows(s).select(
        "symbol", "last_update_id", F.size("bid_prices").alias("n_bids"), F.size("ask_sizes").alias("n_asks"),
        F.get("bid_prices", F.lit(0)).alias("bid"), F.get("bid_sizes", F.lit(1)).alias("second_size"), F.get("ask_sizes", F.lit(0)).alias("ask_size"),
    )
    return rows.join(loaded, "last_update_id")


def gate_archive(spark: SparkSession, d: str) -> DataFrame:
    """Each profile's files, of which profile P4 lacks a manifest."""
    p = table(spark, d, "part")
    kinds = ["bookticker_manifest_1.json", "depth-delta_manifest_1.json", "snapshot_manifest_1.json", "bookticker_part-000001.parquet",
             "depth-delta_part-000001.parquet", "snapshot_part-000001.parquet", "metrics-a-b-2026-04-16.jsonl"]
    profile, no = F.col("p_partkey") % 5, F.floor(F.col("p_partkey") / 5) % len(kinds)
    files = p.where(~((profile == 4) & (no == 2))).select(F.concat(F.lit("P"), profile).alias("profile"), F.get(F.array(*map(F.lit, kinds)), no.cast("int")).alias("file_name"))
    g = gates.archive_gate(files)
    return g.select("profile", *[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in g.columns[1:]])


def gate_upload(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("kind") == "error", "WARN upload failed").when(F.col("kind") == "click", "INFO upload verified bytes=7").otherwise("INFO idle")
    return gates.upload_gate(trades(spark, d).select(F.col("user_id").alias("profile"), line.alias("line")))


def log_reports(spark: SparkSession, d: str) -> DataFrame:
    """Figures of each profile's last report among coloured log lines."""
    q = quotes(spark, d)
    text = F.format_string(
        "\x1b[32mINFO\x1b[0m loss_rate=%s p99_ms=Some(%d) resync_started=%d resync_completed=%d signals_emitted=%d",
        (F.col("bid_qty") / 8).cast("string"), F.col("seq"), F.col("o_custkey"), F.col("o_custkey"), F.col("seq") * 2,
    )
    line = F.when(F.col("seq") % 3 == 0, "INFO nothing to report").otherwise(text)
    return gates.telemetry(q.select(F.col("symbol").alias("profile"), F.col("seq").alias("line_no"), line.alias("line")))


def ntp_times(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    fraction = F.pmod(F.col("trade_id") * 2_654_435_761, F.lit(1 << 32))
    return t.select("trade_id", names.ntp_to_ms(F.col("trade_id") + 3_913_056_000, fraction).alias("ms"))


def avg_bbo_size(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    q = windows.average_bbo(quotes(spark, d).withColumn("ts_ms", day * DAY_MS), 30 * DAY_MS)
    return q.select("symbol", "seq", "n_samples", F.round("avg_bbo", 6).alias("avg_bbo"))


def top5_flow_join(spark: SparkSession, d: str) -> DataFrame:
    """Price-aligned flow of the five best levels between neighbouring year marks, as a full outer join."""
    w = deltas(spark, d)
    marks = w.groupBy("symbol", F.floor(F.col("day") / 365).alias("bucket")).agg(F.max("seq").alias("seq"))
    top = book.top(book.at_marks(w, marks, "bucket", width=MONTH), 5, ("symbol", "bucket")).drop("level")
    flow = book.aligned_flow(top, "bucket")
    return flow.join(marks.select("symbol", "bucket"), ["symbol", "bucket"], "left_semi")


def release_order(spark: SparkSession, d: str) -> DataFrame:
    """Trades and depth events of a symbol in order of release: by hour, trades first, then arrival."""
    t = trades(spark, d).select("symbol", F.lit("trade").alias("kind"), (F.floor(F.col("ts_ms") / 3_600_000) % 500).alias("ts_ms"), F.col("trade_id").alias("arrival_seq"))
    q = quotes(spark, d).select("symbol", F.lit("depth").alias("kind"), (F.col("seq") % 500).alias("ts_ms"), F.col("seq").alias("arrival_seq"))
    return sequence.release_order(t.unionByName(q))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    name = lambda key: names.part_name("snapshot", key * 10, F.lit("x"), F.lit("y"), key)
    key = F.col("p_partkey")
    found = table(spark, d, "part").select(key.alias("part_index"), name(key).alias("file_name"))
    listed = table(spark, d, "lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("part_index")).agg(F.count("*").alias("row_count"))
    listed = listed.select("part_index", name(F.col("part_index")).alias("file_name"), "row_count", F.lit(True).alias("uploaded"))
    return archive.reconcile(found, listed)


def expired_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("metrics-binance-coinm-"), "symbol", F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".jsonl"))
    listing = quotes(spark, d).select("seq", name.alias("file_name"))
    return archive.expired(listing, F.lit("1997-01-01").cast("date"), 30)


def jsonl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are not blank, by source: the row count of line files."""
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.trim("line") != "").groupBy("source").agg(F.count("*").alias("n_rows"))


def level_age(spark: SparkSession, d: str) -> DataFrame:
    """Size-weighted age in days of what is queued, by symbol and side, at day 11000."""
    c = book.changes(deltas(spark, d))
    adds = c.where("change in ('add', 'increase')").select(*book.KEYS, "seq", "day", (F.col("size") - F.col("was")).alias("size"))
    gone = c.groupBy(*book.KEYS).agg(F.sum("drop").alias("removed"))
    left = book.fifo_left(adds, gone).where("left > 0")
    age = F.greatest(F.lit(0), 11_000 - F.col("day"))
    mean = F.sum(F.col("left") * age) / F.sum("left")
    # The SQL's round is of the product, so a half in decimals (41 / 640) can go down; Spark's, of the decimals, takes it up.
    return left.groupBy("symbol", "is_bid").agg((F.round(mean * 1e6) / 1e6).alias("age_days"), F.sum("left").alias("queued"))


def trade_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Drops of levels against trades at the same side, price and bucket: executed first, the rest cancelled."""
    c = book.changes(deltas(spark, d)).where("drop > 0").withColumn("bucket", F.col("day") % 7)
    t = trades(spark, d).withColumn("bucket", F.floor(F.col("ts_ms") / DAY_MS) % 7)
    sums = t.groupBy(*book.KEYS, "bucket").agg(F.sum(F.col("qty").cast("decimal(28,9)")).cast("double").alias("traded"))
    return book.attribute(c.select(*book.KEYS, "bucket", "seq", "drop"), sums).select(*book.KEYS, "bucket", "seq", F.round("executed", 6).alias("executed"), F.round("cancelled", 6).alias("cancelled"))


def concatenated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two objects a line, one line in ten broken behind the first: the whole line is bad then; blank lines are none."""
    q = quotes(spark, d)
    item = lambda k: F.to_json(
        F.struct(F.lit(1).alias("schema_version"), "symbol", (F.col("seq") * k).alias("event_ts_ms"), (F.col("seq") * k + 1).alias("recv_ts_ms"), F.lit("{}").alias("raw_json"))
    )
    two = F.concat(item(1), F.when(F.col("seq") % 2 == 0, "").otherwise("  "), F.when(F.col("seq") % 10 == 0, "{broken").otherwise(item(2)))
    rows = legacy.parse_concatenated(q.select(F.when(F.col("seq") % 7 == 0, " ").otherwise(two).alias("value")))
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.coalesce("symbol", F.lit("")).alias("symbol"), whole("event_ts_ms"), whole("recv_ts_ms"), F.coalesce("raw_json", F.lit("")).alias("raw_json"), "bad")


def base_amounts(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d)
    amount = lambda kind: F.round(signals.base_amount(F.col("bid"), F.col("bid_qty"), kind), 9)
    return q.select("symbol", "seq", amount("linear").alias("linear"), amount("inverse").alias("inverse"))


def chunk_starts(spark: SparkSession, d: str) -> DataFrame:
    """A part begins at the time of its first event in order, which need not be its least."""
    q = quotes(spark, d).withColumn("ts", (F.col("seq") * 7919) % 100_000)
    parts = q.groupBy("symbol", F.floor(F.col("seq") / 1000).alias("part"))
    return parts.agg(F.min_by("ts", "seq").alias("start_ms"), F.min("ts").alias("least_ms"), F.count("*").alias("n_rows"))


def type_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.concat(F.lit("  Nullable( "), F.col("p_brand"), F.lit(" )\t"))
    word = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("t_"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", names.type_name(kind).alias("kind"), names.valid_identifier(word).alias("is_identifier"))


def queue_age_top5(spark: SparkSession, d: str) -> DataFrame:
    """Size-weighted age of the five best levels' queues of each side at day 11000, and the sides' balance."""
    c = book.changes(deltas(spark, d))
    adds = c.where("change in ('add', 'increase')").select(*book.KEYS, "seq", "day", (F.col("size") - F.col("was")).alias("size"))
    gone = c.groupBy(*book.KEYS).agg(F.sum("drop").alias("removed"))
    chunk = F.struct(F.col("left").alias("size"), (F.col("day") * DAY_MS).alias("added_ts"))
    levels = book.fifo_left(adds, gone).where("left > 0").groupBy(*book.KEYS).agg(F.collect_list(chunk).alias("queue"), F.sum("left").alias("size"))
    levels = levels.withColumn("age", signals.level_age_ms(F.col("queue"), F.lit(11_000 * DAY_MS)))
    side = lambda flag: F.sum(F.when(flag, F.col("age") * F.col("size"))) / F.sum(F.when(flag, F.col("size")))
    bid, ask = side(F.col("is_bid")), side(~F.col("is_bid"))
    out = book.top(levels, 5).groupBy("symbol").agg(F.coalesce(bid, F.lit(0.0)).alias("b"), F.coalesce(ask, F.lit(0.0)).alias("a"))
    balance = F.when(F.abs(F.col("b") + F.col("a")) > 1e-9, (F.col("b") - F.col("a")) / (F.col("b") + F.col("a"))).otherwise(0.0)
    return out.select("symbol", F.round("b", 3).alias("bid_age_ms"), F.round("a", 3).alias("ask_age_ms"), F.round(balance, 9).alias("imbalance"))


QUERIES = {
    f.__name__: f
    for f in (
        frame_routes, trade_frames, quote_frames, depth_frames, snapshot_arrays, gate_archive, gate_upload, log_reports, ntp_times, avg_bbo_size,
        top5_flow_join, release_order, manifest_rows, expired_files, jsonl_rows, level_age, trade_attribution,
        concatenated_lines, base_amounts, chunk_starts, type_names, queue_age_top5,
    )
}
