"""The ordered event kernel: reorder buffer, trade matching, queued book, sequence checks, signals.

Everything here depends on the order of arrival and on consumed quantities, which no
relational plan expresses. It imports no Spark; batch and streaming run the same class.
One kernel holds one symbol.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heappop, heappush

from lobspark.config import Settings

#: Tolerances and horizons of the reference's semantics.
EPS = 1e-9
FLOW_EPS = 1e-6
BUCKET_MS = 100
STAT_MS = 60_000
SAMPLE_LEVELS = 50
TRACKED_LEVELS = 20
TRACKED_BAND = 0.02
FLOW_LEVELS = 5
CVD_MS = {"cvd_5s": 5_000, "cvd_1m": 60_000, "cvd_5m": 300_000}
MISSED_BRIDGE, SEQUENCE_GAP, APPLY_FAILED = "MissedBridge", "SequenceGap", "ApplyFailed"


class ReorderBuffer:
    """Holds events back for hold ms and keeps depth until trades have caught up.

    push() takes events in arrival order; drain() gives those that are due, by time,
    trades before depth, arrival order last. Late events are flagged, never dropped.
    """

    def __init__(self, lookahead: int, max_lag: int, hold: int = 20, capacity: int = 50_000, lag_limit: int = 3000):
        self.lookahead, self.max_lag, self.hold = lookahead, max_lag, hold
        self.capacity, self.lag_limit = capacity, lag_limit
        self.reset()

    def reset(self) -> None:
        self.waiting: list[tuple[int, int, int, object]] = []
        self.max_seen: int | None = None
        self.traded: int | None = None
        self.count = 0

    def push(self, ts: int, is_trade: bool, event: object) -> tuple[bool, bool]:
        """(out of order, late)."""
        ts = max(ts, 0)
        seen = self.max_seen
        flags = (seen is not None and ts < seen, seen is not None and ts < seen - self.hold)
        self.max_seen = ts if seen is None else max(seen, ts)
        self.count += 1
        insort(self.waiting, (ts, 0 if is_trade else 1, self.count, event), key=lambda x: x[:3])
        return flags

    def tripped(self) -> bool:
        """Too many events, or too old ones, are waiting."""
        if not self.waiting:
            return False
        return len(self.waiting) > self.capacity or self.max_seen - self.waiting[0][0] > self.lag_limit

    def drain(self, everything: bool = False) -> list[tuple[object, bool]]:
        """(event, forced) in order of release."""
        if self.max_seen is None:
            return []
        due = len(self.waiting) if everything else bisect_left(self.waiting, (self.max_seen - self.hold + 1,), key=lambda x: x[:1])
        out, held = [], []
        for item in self.waiting[:due]:
            ts, kind, _, event = item
            if kind == 0:
                self.traded = ts if self.traded is None else max(self.traded, ts)
                out.append((event, False))
            elif everything:
                out.append((event, False))
            elif self.traded is not None and self.traded >= ts + self.lookahead:
                out.append((event, False))
            elif self.max_seen - (ts + self.lookahead) >= self.max_lag:
                out.append((event, True))
            else:
                held.append(item)
        self.waiting[:due] = held
        return out


class TradeMatcher:
    """Traded quantity by (side, price) in 100 ms buckets; matching consumes it, oldest first.

    Buckets wait in a heap by their start, so that only what expires is looked at.
    """

    def __init__(self):
        self.open: dict[tuple[bool, float], deque] = {}
        self.starts: list[tuple[int, bool, float]] = []

    def record(self, is_bid: bool, price: float, qty: float, ts: int) -> None:
        if qty <= EPS or price <= 0:
            return
        self._prune(ts)
        start = ts - ts % BUCKET_MS
        chunks = self.open.setdefault((is_bid, price), deque())
        if chunks and chunks[-1][0] == start:
            chunks[-1][1] += qty
        else:
            chunks.append([start, qty])
            heappush(self.starts, (start, is_bid, price))

    def consume(self, is_bid: bool, price: float, wanted: float, ts: int) -> float:
        self._prune(ts)
        chunks, left = self.open.get((is_bid, price)), wanted
        while chunks and left > EPS:
            take = min(left, chunks[0][1])
            chunks[0][1] -= take
            left -= take
            if chunks[0][1] <= EPS:
                chunks.popleft()
        if chunks is not None and not chunks:
            del self.open[(is_bid, price)]
        return wanted - left

    def _prune(self, ts: int) -> None:
        while self.starts and self.starts[0][0] < ts - BUCKET_MS:
            _, *key = heappop(self.starts)
            chunks = self.open.get(tuple(key))
            if chunks is None:
                continue
            kept = deque(c for c in chunks if c[0] >= ts - BUCKET_MS)
            if kept:
                self.open[tuple(key)] = kept
            else:
                del self.open[tuple(key)]


@dataclass
class Level:
    """A price level: total size and the queue of chunks [size, added at] it is thought to consist of."""

    total: float = 0.0
    queue: list[list[float]] = field(default_factory=list)

    def push(self, size: float, ts: int) -> None:
        if size > EPS:
            self.queue.append([size, ts])
            self.total += size

    def take_front(self, size: float) -> None:
        for chunk in self.queue:
            take = min(size, chunk[0])
            chunk[0] -= take
            size -= take
        self._settle()

    def take_back(self, size: float) -> None:
        for chunk in reversed(self.queue):
            take = min(size, chunk[0])
            chunk[0] -= take
            size -= take
        self._settle()

    def scale_down(self, size: float) -> None:
        if self.total > EPS:
            keep = max(0.0, (self.total - size) / self.total)
            for chunk in self.queue:
                chunk[0] *= keep
        self._settle()

    def merge(self) -> None:
        if len(self.queue) > 1:
            self.queue = [[self.total, 0]]

    def _settle(self) -> None:
        self.queue = [c for c in self.queue if c[0] > EPS]
        self.total = sum(c[0] for c in self.queue)

    def age(self, ts: int) -> float:
        if self.total <= EPS:
            return 0.0
        return sum(s * max(0, ts - at) for s, at in self.queue if at > 0) / self.total


class Book:
    """Both sides of a book with queued levels."""

    def __init__(self, cancel: str = "lifo"):
        self.sides: tuple[dict[float, Level], dict[float, Level]] = ({}, {})
        self.cancel = cancel

    def load(self, bids, asks) -> None:
        self.sides = ({}, {})
        for side, levels in zip(self.sides, (bids, asks), strict=True):
            for price, size in levels:
                if price > 0 and size > 0:
                    side[price] = Level()
                    side[price].push(size, 0)

    def _side(self, is_bid: bool) -> dict[float, Level]:
        return self.sides[0 if is_bid else 1]

    def prices(self, is_bid: bool) -> list[float]:
        return sorted(self._side(is_bid), reverse=is_bid)

    def best(self, is_bid: bool) -> tuple[float, float] | None:
        side = self._side(is_bid)
        if not side:
            return None
        price = max(side) if is_bid else min(side)
        return price, side[price].total

    def top(self, is_bid: bool, n: int) -> list[tuple[float, float]]:
        side = self._side(is_bid)
        return [(p, side[p].total) for p in self.prices(is_bid)[:n]]

    def size_at(self, is_bid: bool, price: float) -> float:
        level = self._side(is_bid).get(price)
        return level.total if level else 0.0

    def apply(self, bids, asks, plan: dict, ts: int) -> bool:
        """Write absolute sizes; False if the book is crossed or locked afterwards (it stays as written)."""
        for is_bid, levels in ((True, bids), (False, asks)):
            side = self._side(is_bid)
            for price, size in levels:
                if price <= 0:
                    continue
                if size <= 0:
                    side.pop(price, None)
                    continue
                level = side.get(price)
                if level is None:
                    side[price] = Level()
                    side[price].push(size, ts)
                    continue
                change = size - level.total
                if change > EPS:
                    level.push(change, ts)
                elif change < -EPS:
                    executed, cancelled = plan.get((is_bid, price), (0.0, -change))
                    level.take_front(executed)
                    self._cancel(level, cancelled)
                    if level.total - size > EPS:
                        self._cancel(level, level.total - size)
                    if level.total <= EPS:
                        del side[price]
        self._track()
        bid, ask = self.best(True), self.best(False)
        return not (bid and ask and bid[0] >= ask[0])

    def _cancel(self, level: Level, size: float) -> None:
        level.take_back(size) if self.cancel == "lifo" else level.scale_down(size)

    def _track(self) -> None:
        bid, ask = self.best(True), self.best(False)
        mid = (bid[0] + ask[0]) / 2 if bid and ask else None
        for is_bid in (True, False):
            side = self._side(is_bid)
            for i, price in enumerate(self.prices(is_bid)):
                near = mid is not None and mid > 0 and abs(price - mid) / mid <= TRACKED_BAND
                if i >= TRACKED_LEVELS and not near:
                    side[price].merge()

    def notional(self, is_bid: bool, value, band: float = 0.05) -> float:
        best = self.best(is_bid)
        if not best:
            return 0.0
        edge = best[0] * (1 - band if is_bid else 1 + band)
        inside = (lambda p: p >= edge) if is_bid else (lambda p: p <= edge)
        side = self._side(is_bid)
        return sum(value(p, side[p].total) for p in self.prices(is_bid) if inside(p))

    def mean_age(self, is_bid: bool, n: int, ts: int) -> float:
        side = self._side(is_bid)
        levels = [side[p] for p in self.prices(is_bid)[:n]]
        total = sum(x.total for x in levels)
        return sum(x.age(ts) * x.total for x in levels) / total if total > EPS else 0.0


class RollingSum:
    """Sum of what lies within ms before the latest time asked for; the lower edge is inclusive."""

    def __init__(self, ms: int):
        self.ms, self.items, self.total = ms, deque(), 0.0

    def add(self, ts: int, value: float) -> None:
        if abs(value) > EPS:
            self.items.append((ts, value))
            self.total += value
        self.at(ts)

    def at(self, ts: int) -> float:
        while self.items and self.items[0][0] < ts - self.ms:
            self.total -= self.items.popleft()[1]
        if abs(self.total) <= EPS:
            self.total = 0.0
        return self.total


class WallStats:
    """Sizes of top levels and of the best quotes over the last minute."""

    def __init__(self):
        self.levels: dict[tuple[bool, float], deque] = {}
        self.seen: list[tuple[int, int, list[tuple[bool, float]]]] = []  # a heap of what was sampled when
        self.count = 0
        self.quotes: deque = deque()

    def observe(self, book: Book, ts: int) -> None:
        keys = []
        for is_bid in (True, False):
            for price, size in book.top(is_bid, SAMPLE_LEVELS):
                if size > EPS:
                    self.levels.setdefault((is_bid, price), deque()).append((ts, size))
                    keys.append((is_bid, price))
        self.count += 1
        heappush(self.seen, (ts, self.count, keys))
        bid, ask = book.best(True), book.best(False)
        if bid and ask and (bid[1] + ask[1]) / 2 > EPS:
            self.quotes.append((ts, (bid[1] + ask[1]) / 2))
        self.prune(ts)

    def prune(self, ts: int) -> None:
        while self.seen and self.seen[0][0] < ts - STAT_MS:
            for key in heappop(self.seen)[2]:
                q = self.levels.get(key)
                while q and q[0][0] < ts - STAT_MS:
                    q.popleft()
                if q is not None and not q:
                    del self.levels[key]
        while self.quotes and self.quotes[0][0] < ts - STAT_MS:
            self.quotes.popleft()

    def quote_mean(self) -> float | None:
        return sum(s for _, s in self.quotes) / len(self.quotes) if self.quotes else None

    def threshold(self, is_bid: bool, price: float) -> tuple[float, str] | None:
        """Lower of mu + 2 sigma and three times the mean quote, with its name."""
        found = []
        sizes = [s for _, s in self.levels.get((is_bid, price), ())]
        if len(sizes) >= 2:
            mean = sum(sizes) / len(sizes)
            found.append((mean + 2 * math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)), "mu2sigma"))
        quote = self.quote_mean()
        if quote is not None:
            found.append((3 * quote, "3x_bbo"))
        return min(found, key=lambda x: x[0]) if found else None


def ofi_l1(was, now) -> float:
    """Flow at the best levels; was and now are (bids, asks) of (price, size), best first."""

    def side(old, new, is_bid: bool) -> float:
        if not old and not new:
            return 0.0
        if not old:
            return new[0][1]
        if not new:
            return -old[0][1]
        (p0, q0), (p1, q1) = old[0], new[0]
        if abs(p1 - p0) <= EPS:
            return q1 - q0
        return q1 if (p1 > p0) == is_bid else -q0

    return side(was[0], now[0], True) - side(was[1], now[1], False)


def m_ofi(was, now, n: int = FLOW_LEVELS) -> float:
    """Multi-level flow as a difference of depth sums."""
    depth = lambda levels: sum(q for _, q in levels[:n] if q > EPS)
    return (depth(now[0]) - depth(was[0])) - (depth(now[1]) - depth(was[1]))


def balance(a: float, b: float) -> float:
    return (a - b) / (a + b) if abs(a + b) > EPS else 0.0


NO_WALL = (False, 0.0, "none")


def aligned_wall(wall: tuple[bool, float, str], flow: float) -> tuple[bool, float, str]:
    """A wall signal against the flow's side is dropped."""
    against = (wall[2].startswith("ask_wall") and flow < -FLOW_EPS) or (wall[2].startswith("bid_wall") and flow > FLOW_EPS)
    return NO_WALL if against else wall


class Kernel:
    """All of one symbol's state. feed() takes rows as dicts in arrival order and returns output rows.

    A row's kind is snapshot, trade, depth or end; end releases everything that waits. Output
    rows are signals plus 'outcome' and 'reason'; keyframes wait for take_keyframes(),
    counters run on. clock gives milliseconds now; without one (replay) latencies are 0.
    """

    def __init__(self, settings: Settings, clock: Callable[[], float] | None = None):
        s = self.settings = settings
        self.clock = clock
        self.buffer = ReorderBuffer(
            s.execution_match_lookahead_ms, s.trade_alignment_max_lag_ms, s.reorder_hold_ms, s.reorder_capacity,
            s.reorder_resync_max_buffer_lag_ms,
        )
        self.book = Book(s.cancel_heuristic)
        self.last_id: int | None = None
        self.synced = False
        self.matcher, self.walls = TradeMatcher(), WallStats()
        self.cvd = {k: RollingSum(ms) for k, ms in CVD_MS.items()}
        self.snapshots: deque = deque()
        self.next_keyframe: int | None = None
        self.keyframes: list[dict] = []
        self.counters: dict[str, int] = {}

    def _count(self, name: str) -> None:
        self.counters[name] = self.counters.get(name, 0) + 1

    def feed(self, row: dict) -> list[dict]:
        if row["kind"] == "snapshot":
            self.snapshots.append(row)
            if self.last_id is None or not self.synced and self._waits:
                self._replace()
            return self._release() if self.last_id is not None else []
        if row["kind"] == "end":
            return self.finish()
        is_trade = row["kind"] == "trade"
        self._count("total_agg_trade_events" if is_trade else "total_depth_events")
        late = self.buffer.push(row["event_ts_ms"], is_trade, row)
        for flag, name in zip(late, ("out_of_order_corrections", "late_event_corrections"), strict=True):
            if flag:
                self._count(name)
        if self.buffer.tripped():
            self._count("reorder_buffer_guard_triggers")
            self.buffer.reset()
            self._resync()
            return []
        return self._release()

    def finish(self) -> list[dict]:
        """The end of the stream: everything that waits is released."""
        return self._release(everything=True)

    def take_keyframes(self) -> list[dict]:
        """Keyframes since the last call."""
        out, self.keyframes = self.keyframes, []
        return out

    _waits = False

    def _release(self, everything: bool = False) -> list[dict]:
        if self.last_id is None and not self.snapshots:
            return []
        if self.last_id is None:
            self._replace()
        out = []
        for row, forced in self.buffer.drain(everything):
            if row["kind"] == "trade":
                self.trade(row)
            else:
                out += self.depth(row, forced)
        return out

    def _replace(self) -> None:
        """Take the next snapshot: book, id and sync start anew; matcher, CVD and samples stay."""
        s = self.snapshots.popleft()
        self.book.load(s["bids"], s["asks"])
        self.last_id, self.synced, self._waits = s["final_update_id"], False, False
        step = self.settings.snapshot_dump_interval_secs * 1000
        self.next_keyframe = s["event_ts_ms"] + step if step else None

    def _resync(self) -> None:
        self._count("resync_started")
        self.synced, self._waits = False, True
        if self.snapshots:
            self._replace()
            self._count("resync_completed")

    def trade(self, row: dict) -> None:
        price, qty, ts = row["price"], row["qty"], row["event_ts_ms"]
        if price is None or qty is None:
            return
        maker = bool(row["buyer_is_maker"])
        self.matcher.record(maker, price, qty, ts)
        for c in self.cvd.values():
            c.add(ts, -qty if maker else qty)

    def plan(self, row: dict) -> dict:
        """(side, price) to (executed, cancelled) of every level that shrinks; consumes trades."""
        out = {}
        for is_bid, levels in ((True, row["bids"]), (False, row["asks"])):
            for price, size in levels:
                was = self.book.size_at(is_bid, price)
                if size + EPS < was:
                    executed = self.matcher.consume(is_bid, price, was - max(size, 0.0), row["event_ts_ms"])
                    out[(is_bid, price)] = (executed, was - max(size, 0.0) - executed)
        return out

    def wall(self, plan: dict, cvd_5s: float, ts: int) -> tuple[bool, float, str]:
        """The strongest pulled wall of either side."""
        self.walls.prune(ts)
        quote: float | None = None
        best: dict[bool, tuple[float, str]] = {}
        for (is_bid, price), (_, cancelled) in sorted(plan.items(), key=lambda x: x[0][1]):
            size = self.book.size_at(is_bid, price)
            swept = cvd_5s > EPS if is_bid else cvd_5s < -EPS
            if size <= EPS or not swept:
                continue
            ratio = min(1.0, max(0.0, cancelled / size))
            if ratio + EPS < 0.8:
                continue
            limit = self.walls.threshold(is_bid, price)  # the costly test comes last
            if limit is None or not math.isfinite(limit[0]) or limit[0] <= EPS or size + EPS < limit[0]:
                continue
            if quote is None:
                quote = self.walls.quote_mean() or 0.0
            clamp = lambda x, hi: min(hi, max(0.0, x))
            score = 10 * (
                0.45 * clamp(size / limit[0] - 1, 2.0) / 2
                + 0.45 * clamp((ratio - 0.8) / 0.2, 1.0)
                + 0.10 * clamp(abs(cvd_5s) / (1 + quote), 1.0)
            )
            score = min(10.0, score)
            name = "bid_wall_cancel_after_buy_sweep" if is_bid else "ask_wall_cancel_after_sell_sweep"
            if score > best.get(is_bid, (0.0, ""))[0]:
                best[is_bid] = (score, f"{name}_{limit[1]}")
        bid, ask = best.get(True, (0.0, "none")), best.get(False, (0.0, "none"))
        top = ask if ask[0] > bid[0] else bid
        return (True, *top) if top[0] > 0 else NO_WALL

    def depth(self, row: dict, forced: bool = False) -> list[dict]:
        ts = row["event_ts_ms"]
        was = (self.book.top(True, FLOW_LEVELS), self.book.top(False, FLOW_LEVELS))
        cvd = {k: c.at(ts) for k, c in self.cvd.items()}
        plan = self.plan(row)  # before the sequence check: ignored events consume trades too
        wall = self.wall(plan, cvd["cvd_5s"], ts)
        outcome, reason = self._sequence(row, plan)
        if forced:
            self._count("trade_alignment_forced_open")
        if outcome == "ignored":
            return []
        signal = self.signal(row, was, cvd, wall, forced, stale=outcome == "resync")
        if outcome == "resync":
            self._count("sequence_gap_events")
            self._resync()
        elif self.next_keyframe is not None and ts >= self.next_keyframe:
            step = self.settings.snapshot_dump_interval_secs * 1000
            self.next_keyframe += ((ts - self.next_keyframe) // step + 1) * step
            self.keyframes.append({"snapshot_ts_ms": ts, "symbol": row["symbol"], "last_update_id": self.last_id, "snapshot_source": "local_keyframe", "bids": self.book.top(True, 10**9), "asks": self.book.top(False, 10**9)})
        if signal is None:
            return []
        self._count("stale_signals_emitted" if outcome == "resync" else "signals_emitted")
        return [signal | {"outcome": outcome, "reason": reason}]

    def _sequence(self, row: dict, plan: dict) -> tuple[str, str | None]:
        first, final, last = row["first_update_id"], row["final_update_id"], self.last_id
        if final <= last:
            return "ignored", None
        if not self.synced:
            if not first <= last + 1:
                return "resync", MISSED_BRIDGE
        elif not (first <= last + 1 if self.settings.overlap_allowed else row["prev_final_update_id"] == last):
            return "resync", SEQUENCE_GAP
        if not self.book.apply(row["bids"], row["asks"], plan, row["event_ts_ms"]):
            return "resync", APPLY_FAILED
        self.last_id, self.synced = final, True
        self.walls.observe(self.book, row["event_ts_ms"])
        return "emit", None

    def signal(self, row: dict, was, cvd: dict, wall, forced: bool, stale: bool) -> dict | None:
        s, b, ts = self.settings, self.book, row["event_ts_ms"]
        bid, ask = b.best(True), b.best(False)
        if not bid or not ask or bid[0] <= 0 or ask[0] <= 0:
            return None
        mid = (bid[0] + ask[0]) / 2
        value = (lambda p, q: p * q) if s.contract == "linear" else (lambda p, q: q * s.contract_size)
        held = lambda p, q: value(p, q) if p > 0 and q > 0 else 0.0
        bids, asks = b.notional(True, held), b.notional(False, held)
        now = (b.top(True, FLOW_LEVELS), b.top(False, FLOW_LEVELS))
        flow = m_ofi(was, now)
        flag, score, why = aligned_wall(wall, flow)
        size = bid[1] + ask[1]
        age = lambda is_bid, n: b.mean_age(is_bid, n, ts)
        ages = {f"vwaa_{n}": (age(True, k), age(False, k)) for n, k in (("l1", 1), ("top5", FLOW_LEVELS))}
        prev = row["prev_final_update_id"]
        return {
            "schema_version": 1, "exchange": s.exchange, "market": s.market, "symbol": row["symbol"],
            "event_id": f"{s.exchange}:{s.market}:{row['symbol']}:{row['final_update_id']}",
            "event_ts_ms": ts, "recv_ts_ms": row["recv_ts_ms"], "stale_state": stale, "trade_alignment_forced_open": forced,
            "best_bid": bid[0], "best_ask": ask[0], "mid_price": mid, "spread_bps": (ask[0] - bid[0]) / mid * 10_000,
            "bid_notional_5pct": bids, "ask_notional_5pct": asks,
            "imbalance_5pct": (bids - asks) / (bids + asks) if bids + asks > 0 else 0.0,
            "microprice": (ask[0] * bid[1] + bid[0] * ask[1]) / size if size > 0 else mid,
            "ofi_l1": ofi_l1(was, now), "m_ofi_top5": flow,
            "vwaa_l1_bid_ms": ages["vwaa_l1"][0], "vwaa_l1_ask_ms": ages["vwaa_l1"][1], "vwaa_l1_imbalance": balance(*ages["vwaa_l1"]),
            "vwaa_top5_bid_ms": ages["vwaa_top5"][0], "vwaa_top5_ask_ms": ages["vwaa_top5"][1], "vwaa_top5_imbalance": balance(*ages["vwaa_top5"]),
            **cvd, "spoof_flag": flag, "spoof_score": score, "spoof_reason_code": why,
            "depth_update_u": row["final_update_id"], "depth_update_pu": prev if prev is not None else max(row["first_update_id"] - 1, 0),
            "ingest_to_signal_ms": max(0, int(self.clock()) - (row["recv_ts_ms"] or 0)) if self.clock else 0,
        }
