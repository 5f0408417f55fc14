"""Schemas of events, archives and signals. Never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOLEAN, INT = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()


def _of(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


LEVELS = T.ArrayType(_of(price=DOUBLE, size=DOUBLE))
_ID = {"exchange": STRING, "market": STRING, "symbol": STRING}

DEPTH_EVENT = _of(
    arrival_seq=LONG, recv_ts_ms=LONG, event_ts_ms=LONG, **_ID,
    first_update_id=LONG, final_update_id=LONG, prev_final_update_id=LONG, bids=LEVELS, asks=LEVELS,
)
TRADE_EVENT = _of(
    arrival_seq=LONG, recv_ts_ms=LONG, event_ts_ms=LONG, **_ID, trade_id=LONG, price=DOUBLE, qty=DOUBLE, buyer_is_maker=BOOLEAN
)
SNAPSHOT_EVENT = _of(arrival_seq=LONG, snapshot_ts_ms=LONG, **_ID, last_update_id=LONG, snapshot_source=STRING, bids=LEVELS, asks=LEVELS)
QUOTE_EVENT = _of(recv_ts_ms=LONG, event_ts_ms=LONG, symbol=STRING, raw_json=STRING, schema_version=INT)
#: One row for any event; kind is snapshot, trade or depth.
UNIFIED_EVENT = _of(
    kind=STRING, arrival_seq=LONG, recv_ts_ms=LONG, event_ts_ms=LONG, **_ID,
    first_update_id=LONG, final_update_id=LONG, prev_final_update_id=LONG, bids=LEVELS, asks=LEVELS,
    price=DOUBLE, qty=DOUBLE, buyer_is_maker=BOOLEAN,
)

DEPTH_DELTA = _of(
    recv_ts_ms=LONG, event_ts_ms=LONG, **_ID, is_bid=BOOLEAN, price=DOUBLE, size=DOUBLE,
    first_update_id=LONG, final_update_id=LONG, schema_version=INT,
)
_PRICES = T.ArrayType(DOUBLE)
SNAPSHOT = _of(
    snapshot_ts_ms=LONG, **_ID, last_update_id=LONG, snapshot_source=STRING,
    bid_prices=_PRICES, bid_sizes=_PRICES, ask_prices=_PRICES, ask_sizes=_PRICES, schema_version=INT,
)
SIGNAL = _of(
    schema_version=INT, **_ID, event_id=STRING, event_ts_ms=LONG, recv_ts_ms=LONG,
    stale_state=BOOLEAN, trade_alignment_forced_open=BOOLEAN,
    best_bid=DOUBLE, best_ask=DOUBLE, mid_price=DOUBLE, spread_bps=DOUBLE,
    bid_notional_5pct=DOUBLE, ask_notional_5pct=DOUBLE, imbalance_5pct=DOUBLE, microprice=DOUBLE,
    ofi_l1=DOUBLE, m_ofi_top5=DOUBLE,
    vwaa_l1_bid_ms=DOUBLE, vwaa_l1_ask_ms=DOUBLE, vwaa_l1_imbalance=DOUBLE,
    vwaa_top5_bid_ms=DOUBLE, vwaa_top5_ask_ms=DOUBLE, vwaa_top5_imbalance=DOUBLE,
    cvd_5s=DOUBLE, cvd_1m=DOUBLE, cvd_5m=DOUBLE,
    spoof_flag=BOOLEAN, spoof_score=DOUBLE, spoof_reason_code=STRING,
    depth_update_u=LONG, depth_update_pu=LONG, ingest_to_signal_ms=LONG,
)
MANIFEST = T.StructType(
    [
        T.StructField("schema_version", INT),
        T.StructField("date_key", STRING),
        T.StructField("next_part_index", LONG),
        T.StructField("parts", T.ArrayType(_of(part_index=LONG, file_name=STRING, row_count=LONG, uploaded=BOOLEAN))),
    ]
)
PAIRS = T.ArrayType(T.ArrayType(STRING))
#: Wire messages; names that differ only by case need spark.sql.caseSensitive, so decoders read them by JSON path.
ENVELOPE = _of(stream=STRING, data=STRING)


def contract_errors(actual: T.StructType, required: T.StructType) -> list[str]:
    """Columns of required that are missing or of another type. Further columns are fine; boolean and tinyint are one."""
    alike = lambda t: {"boolean": "tinyint", "uint8": "tinyint"}.get(t, t)
    have = {f.name: f.dataType.simpleString().lower() for f in actual}
    errors = []
    for f in required:
        want = f.dataType.simpleString().lower()
        if f.name not in have:
            errors.append(f"{f.name}: missing")
        elif alike(have[f.name]) != alike(want):
            errors.append(f"{f.name}: {have[f.name]} instead of {want}")
    return errors
