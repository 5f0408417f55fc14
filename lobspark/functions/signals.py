"""Per-row signal expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances of the reference's arithmetic; they decide results.
PRICE_EPS = 1e-9
QTY_EPS = 1e-9
M_OFI_EPS = 1e-6


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when(mid(bid, ask) > 0, (ask - bid) / mid(bid, ask) * 10_000)


def share(left: Column, right: Column, eps: float = 0.0) -> Column:
    """(left - right) / (left + right), 0 where the sum is not above eps."""
    total = left + right
    far = (F.abs(total) > eps) if eps else (total > 0)
    return F.when(far, (left - right) / total).otherwise(0.0)


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    total = bid_qty + ask_qty
    return F.when(total > 0, (ask * bid_qty + bid * ask_qty) / total).otherwise(mid(bid, ask))


def quote_notional(price: Column, qty: Column, contract: str, size: float = 100.0) -> Column:
    value = price * qty if contract == "linear" else qty * F.lit(size)
    return F.when((price > 0) & (qty > 0), value).otherwise(0.0)


def base_amount(price: Column, qty: Column, contract: str, size: float = 100.0) -> Column:
    value = qty if contract == "linear" else qty * F.lit(size) / price
    return F.when((price > 0) & (qty > 0), value).otherwise(0.0)


def ofi_side(price: Column, qty: Column, was_price: Column, was_qty: Column, is_bid: bool) -> Column:
    """Flow at one side's best level between two states of the book; null price: no level."""
    better = price > was_price + PRICE_EPS if is_bid else price < was_price - PRICE_EPS
    return (
        F.when(price.isNull() & was_price.isNull(), 0.0)
        .when(was_price.isNull(), qty)
        .when(price.isNull(), -was_qty)
        .when(F.abs(price - was_price) <= PRICE_EPS, qty - was_qty)
        .when(better, qty)
        .otherwise(-was_qty)
    )


def ofi_l1(b: Column, bq: Column, a: Column, aq: Column, wb: Column, wbq: Column, wa: Column, waq: Column) -> Column:
    return ofi_side(b, bq, wb, wbq, True) - ofi_side(a, aq, wa, waq, False)


def m_ofi(bid_depth: Column, ask_depth: Column, was_bid_depth: Column, was_ask_depth: Column) -> Column:
    """Multi-level flow: price-aligned differences telescope to differences of depth sums."""
    return (bid_depth - was_bid_depth) - (ask_depth - was_ask_depth)


def aligned(flag_reason: Column, flow: Column) -> Column:
    """True where a wall signal is kept: its side must not be against the flow."""
    ask_wall = flag_reason.startswith("ask_wall") & (flow < -M_OFI_EPS)
    bid_wall = flag_reason.startswith("bid_wall") & (flow > M_OFI_EPS)
    return ~(ask_wall | bid_wall)


def event_id(exchange: Column, market: Column, symbol: Column, final_id: Column) -> Column:
    return F.concat_ws(":", exchange, market, symbol, final_id.cast("string"))


def followed_id(prev_final: Column, first: Column) -> Column:
    return F.coalesce(prev_final, F.greatest(first - 1, F.lit(0)))


def signed_qty(buyer_is_maker: Column, qty: Column) -> Column:
    return F.when(buyer_is_maker, -qty).otherwise(qty)


def level_age_ms(queue: Column, at: Column) -> Column:
    """Size-weighted age of array<struct<size, added_ts>>; unknown times (not above 0) are age 0."""
    total = F.aggregate(queue, F.lit(0.0), lambda s, c: s + c["size"])
    aged = F.aggregate(
        queue,
        F.lit(0.0),
        lambda s, c: s + F.when(c["added_ts"] > 0, c["size"] * F.greatest(at - c["added_ts"], F.lit(0))).otherwise(0.0),
    )
    return F.when(total > QTY_EPS, aged / total).otherwise(0.0)


def wall_score(wall: Column, cancelled: Column, threshold: Column, cvd: Column, avg_bbo: Column) -> Column:
    """0 to 10 for a wall that was pulled; callers have checked that it is one."""
    clamp = lambda x, hi: F.greatest(F.lit(0.0), F.least(x, F.lit(hi)))
    ratio = clamp(cancelled / wall, 1.0)
    size = clamp(wall / threshold - 1, 2.0) / 2
    pull = clamp((ratio - 0.8) / 0.2, 1.0)
    drive = clamp(F.abs(cvd) / (1 + avg_bbo), 1.0)
    return F.least(F.lit(10.0), 10 * (0.45 * size + 0.45 * pull + 0.10 * drive))
