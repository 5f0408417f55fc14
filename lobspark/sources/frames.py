"""Wire frames: text to envelopes to typed events. Names that differ by case only are read by JSON path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.schemas import PAIRS


def stream_path(symbol: str, *, depth: bool = True, quotes: bool = True, trades: bool = True) -> str:
    """The subscription of a combined stream; at least one stream is needed."""
    parts = [f"{symbol}@{s}" for s, on in (("depth@100ms", depth), ("bookTicker", quotes), ("aggTrade", trades)) if on]
    if not parts:
        raise ValueError("no stream is switched on")
    return "/".join(parts)


def route(frames: DataFrame, value: str = "value") -> DataFrame:
    """frames with stream, data (JSON text), kind (depth, quote, trade or bad)."""
    at = lambda path: F.get_json_object(F.col(value), path)
    d = frames.withColumns({"stream": at("$.stream"), "data": at("$.data")})
    event, name = F.get_json_object("data", "$.e"), F.lower("stream")
    kind = (
        F.when(F.col("data").isNull() | F.col("stream").isNull(), "bad")
        .when(event == "depthUpdate", "depth").when(event == "bookTicker", "quote").when(event == "aggTrade", "trade")
        .when(name.contains("@depth"), "depth").when(name.contains("@bookticker"), "quote").when(name.contains("@aggtrade"), "trade")
        .otherwise("bad")
    )
    return d.withColumn("kind", kind)


def _field(path: str, kind: str = "string") -> Column:
    return F.get_json_object("data", f"$.{path}").try_cast(kind)


def levels(json: Column) -> Column:
    """[[price, size], ..] text to array<struct<price, size>>; unreadable numbers are null."""
    pairs = F.from_json(json, PAIRS)
    return F.transform(pairs, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("price"), F.get(p, 1).try_cast("double").alias("size")))


def valid_levels(ls: Column) -> Column:
    """The archive's rule: numeric, price above 0, size not below 0."""
    return F.filter(ls, lambda x: x["price"].isNotNull() & x["size"].isNotNull() & (x["price"] > 0) & (x["size"] >= 0))


def decode_depth(routed: DataFrame) -> DataFrame:
    ok = routed.where((F.col("kind") == "depth") & (_field("e") == "depthUpdate"))
    return ok.select(
        *[c for c in ("arrival_seq", "recv_ts_ms") if c in routed.columns],
        _field("E", "bigint").alias("event_ts_ms"), _field("T", "bigint").alias("transaction_time_ms"),
        F.upper(_field("s")).alias("symbol"), _field("ps").alias("pair"),
        _field("U", "bigint").alias("first_update_id"), _field("u", "bigint").alias("final_update_id"),
        _field("pu", "bigint").alias("prev_final_update_id"), levels(_field("b")).alias("bids"), levels(_field("a")).alias("asks"),
    )


def decode_quotes(routed: DataFrame) -> DataFrame:
    """Spot quotes carry neither type nor time: the receive time stands in."""
    event = F.coalesce(_field("e"), F.lit("bookTicker"))
    ok = routed.where((F.col("kind") == "quote") & (event == "bookTicker"))
    return ok.select(
        "recv_ts_ms", F.coalesce(_field("E", "bigint"), F.col("recv_ts_ms")).alias("event_ts_ms"), F.upper(_field("s")).alias("symbol"),
        _field("u", "bigint").alias("update_id"), _field("b", "double").alias("bid"), _field("B", "double").alias("bid_qty"),
        _field("a", "double").alias("ask"), _field("A", "double").alias("ask_qty"), F.col("data").alias("raw_json"), F.lit(1).alias("schema_version"),
    )


def decode_trades(routed: DataFrame) -> DataFrame:
    """Trades with unreadable price or quantity are left out."""
    ok = routed.where((F.col("kind") == "trade") & (_field("e") == "aggTrade"))
    d = ok.select(
        *[c for c in ("arrival_seq", "recv_ts_ms") if c in routed.columns],
        _field("E", "bigint").alias("event_ts_ms"), _field("T", "bigint").alias("trade_time_ms"), F.upper(_field("s")).alias("symbol"),
        _field("a", "bigint").alias("trade_id"), _field("p", "double").alias("price"), _field("q", "double").alias("qty"),
        _field("f", "bigint").alias("first_trade_id"), _field("l", "bigint").alias("last_trade_id"), _field("m", "boolean").alias("buyer_is_maker"),
    )
    return d.where("price is not null and qty is not null")


def decode_snapshots(raw: DataFrame, value: str = "value") -> DataFrame:
    """REST snapshots, strict: a level that is not numeric fails the query; price <= 0 and size < 0 are dropped."""
    pairs = lambda path: F.from_json(F.get_json_object(F.col(value), path), PAIRS)
    strict = lambda ps: F.transform(ps, lambda p: F.struct(F.get(p, 0).cast("double").alias("price"), F.get(p, 1).cast("double").alias("size")))
    keep = lambda ls: F.filter(ls, lambda x: (x["price"] > 0) & (x["size"] >= 0))
    rest = [c for c in raw.columns if c != value]
    return raw.select(
        *rest, F.get_json_object(F.col(value), "$.lastUpdateId").cast("bigint").alias("last_update_id"),
        keep(strict(pairs("$.bids"))).alias("bids"), keep(strict(pairs("$.asks"))).alias("asks"),
    )


def delta_rows(depth: DataFrame) -> DataFrame:
    """One row a valid level, bids first, in the archive's columns."""
    side = lambda c, bid: F.transform(valid_levels(F.col(c)), lambda x: F.struct(F.lit(bid).alias("is_bid"), x["price"].alias("price"), x["size"].alias("size")))
    d = depth.withColumn("l", F.explode(F.concat(side("bids", True), side("asks", False))))
    return d.select(
        "recv_ts_ms", "event_ts_ms", "exchange", "market", "symbol", "l.is_bid", "l.price", "l.size",
        "first_update_id", "final_update_id", F.lit(1).alias("schema_version"),
    )


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """Snapshots with four parallel arrays, as they are archived."""
    part = lambda c, f: F.transform(c, lambda x: x[f])
    return snapshots.select(
        "snapshot_ts_ms", "exchange", "market", "symbol", "last_update_id", "snapshot_source",
        part("bids", "price").alias("bid_prices"), part("bids", "size").alias("bid_sizes"),
        part("asks", "price").alias("ask_prices"), part("asks", "size").alias("ask_sizes"), F.lit(1).alias("schema_version"),
    )
