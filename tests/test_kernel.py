"""Hand-computed cases of the ordered kernel."""

import pytest

from lobspark.config import Settings
from lobspark.operators import kernel as k

S = Settings()


def depth(first, final, prev, bids=(), asks=(), ts=None):
    return {
        "kind": "depth", "symbol": "BTCUSD_PERP", "event_ts_ms": final if ts is None else ts, "recv_ts_ms": 0, "first_update_id": first,
        "final_update_id": final, "prev_final_update_id": prev, "bids": list(bids), "asks": list(asks),
    }


def snapshot(last=100, bids=((100.0, 2.0), (99.5, 1.0)), asks=((101.0, 2.0), (101.5, 1.0)), ts=0):
    return {"kind": "snapshot", "event_ts_ms": ts, "final_update_id": last, "bids": list(bids), "asks": list(asks)}


def started(settings=S, **snap):
    kernel = k.Kernel(settings)
    kernel.feed(snapshot(**snap))
    return kernel


def synced():
    kernel = started()
    assert kernel.depth(depth(100, 101, 99, [(100.0, 2.5)]))[0]["outcome"] == "emit"
    assert kernel.synced and kernel.last_id == 101
    return kernel


def test_missed_bridge():
    kernel = started()
    out = kernel.depth(depth(105, 106, 104, [(100.0, 1.0)]))
    assert (out[0]["reason"], out[0]["stale_state"], kernel.synced, kernel.last_id) == ("MissedBridge", True, False, 100)


def test_stale_update_is_ignored():
    kernel = synced()
    assert kernel.depth(depth(100, 101, 100, [(99.0, 1.2)])) == [] and kernel.last_id == 101


def test_gap():
    kernel = synced()
    out = kernel.depth(depth(102, 103, 99, [(100.0, 3.0)]))
    assert out[0]["reason"] == "SequenceGap" and out[0]["ofi_l1"] == 0 and kernel.last_id == 101


def test_crossed_book():
    kernel = synced()
    out = kernel.depth(depth(102, 102, 101, [(102.5, 1.0)]))
    assert out[0]["reason"] == "ApplyFailed" and out[0]["spread_bps"] < 0 and kernel.last_id == 101


def test_spot_overlap_and_gap():
    spot = Settings(market="spot", symbol="BTCUSD")
    kernel = started(spot)
    assert kernel.depth(depth(101, 101, None, [(100.0, 2.0)])) and kernel.depth(depth(101, 102, None, [(100.0, 2.1)]))
    assert kernel.last_id == 102
    kernel = started(spot)
    kernel.depth(depth(101, 101, None))
    assert kernel.depth(depth(103, 103, None))[0]["reason"] == "SequenceGap"


def test_resync_takes_the_next_snapshot_and_keeps_trades():
    kernel = synced()
    kernel.trade({"price": 100.0, "qty": 1.0, "event_ts_ms": 150, "buyer_is_maker": True})
    kernel.snapshots.append(snapshot(250, [(200.0, 1.0)], [(201.0, 1.0)]))
    kernel.depth(depth(105, 106, 104))
    assert not kernel.synced and kernel.last_id == 250
    assert (kernel.book.best(True)[0], kernel.book.best(False)[0]) == (200.0, 201.0)
    assert kernel.matcher.open and kernel.cvd["cvd_5s"].items


def test_flows():
    assert k.ofi_l1(([(100, 2)], [(101, 3)]), ([(100.5, 5)], [(101.5, 1)])) == 8.0
    assert k.m_ofi(([(100, 2), (99.5, 4)], [(101, 3), (101.5, 2)]), ([(100, 5), (99, 1)], [(101, 1), (102, 2)]), 2) == 2.0
    was = [(100, 5), (99, 10), (98, 10)]
    assert k.m_ofi((was, [(102, 1)]), ([(101, 2), *was], [(102, 1)]), 4) == 2.0


def test_cvd_lower_edge_is_inclusive():
    sums = {ms: k.RollingSum(ms) for ms in (5_000, 60_000, 300_000)}
    for ts, q in ((1000, 2), (2000, -1), (58_000, 3), (62_000, -2)):
        for s in sums.values():
            s.add(ts, q)
    assert [s.at(62_000) for s in sums.values()] == [1, 0, 2]


def level(*chunks):
    return k.Level(sum(c[0] for c in chunks), [list(c) for c in chunks])


def test_queues():
    x = level((2.0, 10), (3.0, 20))
    x.take_front(2.5)
    assert x.queue == [[2.5, 20]] and x.total == 2.5
    x = level((2.0, 10), (3.0, 20))
    x.take_back(2.5)
    assert [c[0] for c in x.queue] == [2.0, 0.5]
    x = level((2.0, 10), (3.0, 20))
    x.scale_down(1.0)
    assert [round(c[0], 9) for c in x.queue] == [1.6, 2.4] and round(x.total, 9) == 4.0
    assert level((2.0, 1000), (3.0, 2000)).age(4000) == 2400


def test_deep_levels_collapse():
    book = k.Book()
    book.load([(100.0 - i, 1.0) for i in range(25)], [(101.0 + i, 1.0) for i in range(25)])
    book.apply([(95.0, 3.0), (76.0, 3.0)], [], {}, 500)
    assert len(book.sides[0][95.0].queue) >= 2 and len(book.sides[0][76.0].queue) == 1


def test_executed_before_cancelled():
    kernel = started()
    kernel.depth(depth(100, 101, 99, [(100.0, 5.0)], ts=1000))
    kernel.trade({"price": 100.0, "qty": 2.0, "event_ts_ms": 1040, "buyer_is_maker": True})
    row = depth(102, 102, 101, [(100.0, 3.0)], ts=1050)
    plan = kernel.plan(row)
    assert plan[(True, 100.0)] == (2.0, 0.0)
    kernel.book.apply(row["bids"], [], plan, 1050)
    assert kernel.book.sides[0][100.0].queue == [[3.0, 1000]]


def test_bucket_phase_decides_expiry():
    for trade, at, found in ((199, 201, 0.0), (200, 300, 1.0)):
        m = k.TradeMatcher()
        m.record(True, 100.0, 1.0, trade)
        assert m.consume(True, 100.0, 1.0, at) == found


def test_ignored_events_still_consume_trades():
    kernel = synced()
    kernel.trade({"price": 100.0, "qty": 1.0, "event_ts_ms": 101, "buyer_is_maker": True})
    assert kernel.depth(depth(100, 101, 100, [(100.0, 1.0)])) == []
    assert not kernel.matcher.open


@pytest.mark.parametrize(("contract", "bids", "asks"), [("inverse", 500, 500), ("linear", 497, 509)])
def test_notional(contract, bids, asks):
    s = Settings(contract=contract)
    kernel = started(s, bids=[(100.0, 2.0), (99.0, 3.0)], asks=[(101.0, 1.0), (102.0, 4.0)])
    row = kernel.depth(depth(100, 101, 99))[0]
    assert (row["bid_notional_5pct"], row["ask_notional_5pct"]) == (bids, asks)


def test_wall_alignment():
    ask, bid = (True, 5.0, "ask_wall_cancel_after_sell_sweep_mu2sigma"), (True, 5.0, "bid_wall_cancel_after_buy_sweep_3x_bbo")
    assert k.aligned_wall(ask, -25) == (False, 0.0, "none") and k.aligned_wall(bid, -10) == bid


def test_wall_fires():
    kernel = synced()
    for i in range(102, 108):
        kernel.depth(depth(i, i, i - 1, [(100.0, 2.0)]))
    kernel.depth(depth(108, 108, 107, [(100.0, 12.0)]))
    kernel.cvd["cvd_5s"].add(108, 5.0)
    row = kernel.depth(depth(109, 109, 108, [(100.0, 1.0)]))[0]
    assert row["spoof_flag"] and row["spoof_score"] > 0 and row["spoof_reason_code"].startswith("bid_wall_cancel_after_buy_sweep")


def released(lookahead, lag, steps):
    b, out = k.ReorderBuffer(lookahead, lag), []
    for step in steps:
        for kind, ts in step:
            b.push(ts, kind == "T", f"{kind}{ts}")
        out.append([f"{e}{'!' if forced else ''}" for e, forced in b.drain()])
    return out


@pytest.mark.parametrize(
    ("lookahead", "lag", "steps", "want"),
    [
        (0, 20, [[("D", 120), ("T", 90)], [("D", 140)]], [["T90"], ["D120!"]]),
        (0, 100, [[("D", 120), ("T", 120), ("D", 141)]], [["T120", "D120"]]),
        (0, 100, [[("D", 120), ("D", 141)], [("T", 120), ("D", 160)]], [[], ["T120", "D120"]]),
        (25, 100, [[("D", 120), ("T", 120), ("D", 141)], [("T", 145), ("D", 200)], []], [["T120"], ["T145"], ["D120"]]),
        (0, 30, [[("T", 110), ("D", 120), ("D", 200)]], [["T110", "D120!"]]),
    ],
)
def test_reorder(lookahead, lag, steps, want):
    assert released(lookahead, lag, steps) == want


def test_late_events_are_flagged_not_dropped():
    b = k.ReorderBuffer(0, 20)
    assert [b.push(ts, False, ts) for ts in (120, 110, 90)] == [(False, False), (True, False), (True, True)]
    assert [e for e, _ in b.drain(everything=True)] == [90, 110, 120]


def test_breakers():
    b = k.ReorderBuffer(0, 100, capacity=2)
    for ts in (1, 2, 3):
        b.push(ts, False, ts)
    assert b.tripped()
    b = k.ReorderBuffer(40, 250)  # with defaults a held depth is forced long before the lag breaker
    for ts in range(0, 10_000, 10):
        b.push(ts, False, ts)
        assert not b.tripped()
        b.drain()


def test_keyframes_skip_whole_steps():
    kernel = k.Kernel(Settings(snapshot_dump_interval_secs=1))
    kernel.feed(snapshot(ts=0))
    kernel.depth(depth(100, 101, 99, ts=3500))
    assert len(kernel.keyframes) == 1 and kernel.next_keyframe == 4000
    off = k.Kernel(Settings(snapshot_dump_interval_secs=0))
    off.feed(snapshot())
    assert off.next_keyframe is None
