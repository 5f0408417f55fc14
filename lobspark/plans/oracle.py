"""The same queries in DuckDB's SQL."""

from __future__ import annotations

TRADES = """
trades as (select 'S' || (user_id % 4) as symbol, epoch_us(ts) // 1000 as ts_ms, event_id as trade_id,
  event_type in ('click', 'signup') as buyer_is_maker, event_type in ('click', 'signup') as is_bid, value as qty,
  (100 + (props->>'$.k')::int % 10)::double as price, event_type as kind, user_id from events)"""
DELTAS = """
deltas as (select 'S' || (l_suppkey % 4) as symbol, l_linestatus = 'F' as is_bid,
  (case when l_linestatus = 'F' then 100 - 0.5 * (1 + l_partkey % 40) else 100 + 0.5 * (1 + l_partkey % 40) end)::double as price,
  case when l_returnflag = 'R' then 0.0::double else l_quantity end as size,
  datediff('day', date '1970-01-01', l_shipdate::date)::bigint * 100000000000 + l_orderkey * 100 + l_linenumber as seq,
  datediff('day', date '1970-01-01', l_shipdate::date)::bigint as day from lineitem)"""
QUOTES = """
quotes as (select 'S' || (o_custkey % 4) as symbol, o_orderkey as seq, floor(o_totalprice)::bigint / 100 as bid,
  (floor(o_totalprice)::bigint / 100 + 0.5::double + (o_orderkey % 7) * 0.25::double)::double as ask,
  (1 + o_orderkey % 13)::double as bid_qty, (1 + o_custkey % 11)::double as ask_qty, o_custkey from orders)"""
UPDATES = (
    QUOTES
    + """, numbered as (select *, row_number() over (partition by symbol order by seq) as n from quotes),
updates as (select symbol, seq, n * 10 - 9 as first_update_id, n * 10 as final_update_id,
  n * 10 - 10 - case when seq % 50 = 0 then 3 else 0 end as prev_final_update_id from numbered)"""
)
LIVE = DELTAS + """, live as (select symbol, is_bid, price, arg_max(size, seq) as size, max(seq) as seq from deltas group by all having arg_max(size, seq) > 0)"""
BEST = LIVE + """, best as (select symbol, max(price) filter (is_bid) as best_bid, arg_max(size, price) filter (is_bid) as best_bid_size,
  min(price) filter (not is_bid) as best_ask, arg_min(size, price) filter (not is_bid) as best_ask_size from live group by 1)"""
GAPS = UPDATES + """, g as (select *, lag(final_update_id) over (partition by symbol order by seq) as prev_seen from updates),
gaps as (select *, case when prev_seen is null then 'first' when final_update_id <= prev_seen then 'ignored'
  when prev_final_update_id = prev_seen then 'ok' else 'gap' end as outcome from g)"""
CHANGES = DELTAS + """, c as (select *, coalesce(lag(size) over (partition by symbol, is_bid, price order by seq), 0) as was from deltas),
changes as (select *, case when was = 0 and size > 0 then 'add' when size <= 0 and was > 0 then 'delete' when size > was then 'increase'
  when size < was then 'decrease' else 'same' end as change, greatest(was - size, 0) as drop_ from c)"""
MARKS = DELTAS + """, marks as (select symbol, (day // 365)::bigint as bucket, max(seq) as m from deltas group by all),
spans as (select *, lead(seq) over (partition by symbol, is_bid, price order by seq) as until from deltas),
at_marks as (select s.symbol, bucket, is_bid, price, size from spans s join marks m on s.symbol = m.symbol and s.seq <= m.m
  and (until is null or until > m.m) where size > 0)"""


def _band(value: str) -> str:
    return f"""with {BEST} select l.symbol,
  coalesce(sum(case when is_bid and price >= best_bid * (1 - 0.05) then ({value})::decimal(28,6) end), 0)::double as bid_notional,
  coalesce(sum(case when not is_bid and price <= best_ask * (1 + 0.05) then ({value})::decimal(28,6) end), 0)::double as ask_notional
  from live l join best b on l.symbol = b.symbol group by 1"""


_LEVELS = ", ".join(f"last_value(case when seq % 5 = {k} then {side}_qty end ignore nulls) over w as {side[0]}{k}" for side in ("bid", "ask") for k in range(5))
_SUM = lambda side: " + ".join(f"coalesce({side}{k}, 0)" for k in range(5))
_SIZE = lambda side: " + ".join(f"({side}{k} is not null)::int" for k in range(5))
#: What the kernel makes of the events: book and flow by last write, rolling sums by position (events lie 100 ms apart;
#: a depth event is released after the trade that follows it, but for the last one).
KERNEL = QUOTES + f""", base as (select q.*, datediff('day', date '1970-01-01', o_orderdate::date) // 30 as epoch, datediff('day', date '1970-01-01', o_orderdate::date) as day
  from quotes q join orders on o_orderkey = seq),
rn as (select *, row_number() over (partition by symbol, epoch order by day, seq) as rn, count(*) over (partition by symbol, epoch) as n,
  case when seq % 2 = 0 then -1.0::double else 1.0::double end as sgn from base),
held as (select *, {_LEVELS}, case when rn = n then sgn else 0 end as unseen,
  sum(sgn) over (w rows between 50 preceding and current row) as s5, sum(sgn) over (w rows between 600 preceding and current row) as s60,
  sum(sgn) over (w rows between 3000 preceding and current row) as s300 from rn window w as (partition by symbol, epoch order by rn)),
tops as (select *, case when b4 is not null then 97 when b3 is not null then 96.5 when b2 is not null then 96 when b1 is not null then 95.5 else 95 end::double as bb,
  coalesce(b4, b3, b2, b1, b0) as bq, coalesce(a0, a1, a2, a3, a4) as aq,
  case when a0 is not null then 105 when a1 is not null then 105.5 when a2 is not null then 106 when a3 is not null then 106.5 else 107 end::double as ba,
  {_SUM('b')} as bids, {_SUM('a')} as asks from held),
kernel as (select *, lag(bb) over w as wbb, lag(bq) over w as wbq, lag(ba) over w as wba, lag(aq) over w as waq, lag(bids) over w as wbids, lag(asks) over w as wasks
  from tops window w as (partition by symbol, epoch order by rn))"""
_SIGNED = "case when buyer_is_maker then -qty else qty end::decimal(28,9)"
_CVD = "sum({0}) over (partition by symbol order by ts_ms range between {1} preceding and current row)::double as {2}"
_KEYS = "symbol, is_bid, price"
_FIRST = "row_number() over (partition by user_id, event_type order by event_id{0}) as r"
_NORM = "case when trim(' ' || p_name || '/' || p_brand) = '' then 'unknown' else regexp_replace(lower(trim(' ' || p_name || '/' || p_brand)), '[^a-z0-9_\\-]', '_', 'g') end"

ORACLE = {
    "cvd_windows": f"with {TRADES} select symbol, ts_ms, trade_id, " + ", ".join(
        _CVD.format(f"({_SIGNED})", w, n) for n, w in (("cvd_5s", 5000), ("cvd_1m", 60000), ("cvd_5m", 300000), ("cvd_1h", 3600000))
    ) + " from trades",
    "trade_buckets": f"with {TRADES} select {_KEYS}, ts_ms - ts_ms % 3600000 as bucket_ms, sum(qty::decimal(28,9))::double as qty, count(*) as n_trades from trades group by all",
    "trade_counts_by_kind": f"with {TRADES} select kind, count(*) as n from trades group by 1",
    "latency_p99_nearest": f"""with {TRADES}, held as (select *, row_number() over (partition by symbol order by trade_id desc) as age from trades),
r as (select symbol, qty, count(*) over (partition by symbol) as n, row_number() over (partition by symbol order by qty, trade_id) - 1 as r from held where age <= 20000)
select symbol, qty as p99, n from r where r = floor((n - 1) * 0.99::double + 0.5)""",
    "loss_rate": f"with {GAPS} select symbol, count(*) as depth_events, count(*) filter (outcome = 'gap') as gap_events, count(*) filter (outcome = 'gap') / count(*) as loss_rate from gaps group by 1",
    "book_lww": f"with {LIVE} select * from live",
    "book_best": f"with {BEST} select * from best",
    "book_topn": f"with {LIVE}, r as (select *, row_number() over (partition by symbol, is_bid order by case when is_bid then -price else price end)::int as level from live) select symbol, is_bid, level, price, size from r where level <= 5",
    "book_full": f"""with {LIVE} select symbol, coalesce(string_agg((price * 2)::bigint || ':' || size::bigint, ',' order by price desc) filter (is_bid), '') as bids,
coalesce(string_agg((price * 2)::bigint || ':' || size::bigint, ',' order by price) filter (not is_bid), '') as asks from live group by 1""",
    "book_asof": f"with {DELTAS} select {_KEYS}, arg_max(size, seq) as size, max(seq) as seq from deltas where seq <= 9800 * 100000000000 group by all having arg_max(size, seq) > 0",
    "keyframe_daily": f"with {MARKS} select symbol, bucket, count(*) filter (is_bid) as bids, count(*) filter (not is_bid) as asks, sum(case when is_bid then size else 0 end) as bid_size from at_marks group by all",
    "depth_changes": f"with {CHANGES} select symbol, is_bid, change, count(*) as n, sum(drop_) as dropped from changes group by all",
    "band_notional_linear": _band("price * size"),
    "band_notional_inverse": _band("size * 100.0::double"),
    "quote_spread_micro": f"""with {QUOTES} select symbol, seq, (bid + ask) / 2 as mid_price, round((ask - bid) / ((bid + ask) / 2) * 10000, 6) as spread_bps,
round((ask * bid_qty + bid * ask_qty) / (bid_qty + ask_qty), 6) as microprice from quotes where bid > 0 and ask > 0""",
    "imbalance": f"with n as ({_band('price * size')}) select symbol, round(case when bid_notional + ask_notional > 0 then (bid_notional - ask_notional) / (bid_notional + ask_notional) else 0 end, 9) as imbalance from n",
    "ofi_l1": f"""with {QUOTES}, w as (select *, lag(bid) over o as wb, lag(bid_qty) over o as wbq, lag(ask) over o as wa, lag(ask_qty) over o as waq from quotes window o as (partition by symbol order by seq))
select symbol, seq, (case when wb is null then bid_qty when abs(bid - wb) <= 1e-9 then bid_qty - wbq when bid > wb then bid_qty else -wbq end)
 - (case when wa is null then ask_qty when abs(ask - wa) <= 1e-9 then ask_qty - waq when ask < wa then ask_qty else -waq end) as ofi_l1 from w""",
    "m_ofi_top5": f"""with {MARKS}, r as (select *, row_number() over (partition by symbol, bucket, is_bid order by case when is_bid then -price else price end) as level from at_marks),
s as (select symbol, bucket, sum(case when is_bid then size else 0 end) as b, sum(case when is_bid then 0 else size end) as a from r where level <= 5 group by all)
select symbol, bucket, (b - lag(b, 1, 0) over w) - (a - lag(a, 1, 0) over w) as m_ofi_top5 from s window w as (partition by symbol order by bucket)""",
    "level_stats_mu2sigma": f"""with {DELTAS}, s as (select *, count(*) over w as n_samples, avg(size) over w as m, stddev_pop(size) over w as sd from deltas where size > 1e-9
window w as (partition by {_KEYS} order by day range between 90 preceding and 1 preceding))
select {_KEYS}, seq, n_samples, round(case when n_samples >= 2 then m + 2 * sd end, 6) as threshold from s""",
    "wall_candidates": f"""with {CHANGES}, s as (select *, count(*) over w as n, avg(was) over w + 2 * stddev_pop(was) over w as lim from changes window w as (partition by {_KEYS} order by day range between 90 preceding and 1 preceding)),
k as (select *, round(least(10, 10 * (0.45::double * greatest(0, least(was / lim - 1, 2)) / 2 + 0.45::double * greatest(0, least((greatest(0, least(drop_ / was, 1)) - 0.8::double) / 0.2::double, 1)) + 0.10::double)), 6) as score
  from s where n >= 2 and drop_ > 0 and was >= lim and drop_ >= 0.8 * was and lim > 0),
r as (select *, row_number() over (partition by symbol, day order by score desc, is_bid desc, price, seq) as r from k)
select symbol, day, is_bid, price, seq, score from r where r = 1""",
    "wall_alignment": f"with {TRADES} select trade_id, not ((not is_bid and qty - 25 < -1e-6) or (is_bid and qty - 25 > 1e-6)) as kept from trades",
    "dedup_latest": f"select user_id, event_type, event_id, value from (select *, {_FIRST.format(' desc')} from events) where r = 1",
    "dedup_first": f"select user_id, event_type, event_id, value from (select *, {_FIRST.format('')} from events) where r = 1",
    "sequence_gaps": f"with {GAPS} select symbol, seq, coalesce(prev_seen, -1) as prev_seen, outcome from gaps",
    "bridge_event": f"""with {UPDATES}, s as (select distinct symbol, final_update_id - seq % 23 as last_update_id from updates)
select u.symbol, last_update_id, min(final_update_id) as bridge_id, min(seq) as bridge_seq from updates u join s on s.symbol = u.symbol
and first_update_id <= last_update_id + 1 and final_update_id >= last_update_id + 1 group by all""",
    "orphan_parts": "select printf('depth-delta_%d_%s_%s_part-%06d.parquet', 0, 'x', 'y', p_partkey) as file_name, p_partkey as part_index from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 48)",
    "next_part_index": "select count(*) as orphans, coalesce(max(p_partkey), 0) + 1 as next_index from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 48)",
    "out_of_order_flags": f"""with {TRADES}, a as (select *, (trade_id + user_id % 5) * 10000000 + trade_id as arrival_seq from trades),
m as (select *, max(ts_ms) over (partition by symbol order by arrival_seq rows between unbounded preceding and 1 preceding) as seen from a)
select symbol, trade_id, coalesce(ts_ms < seen, false) as out_of_order, coalesce(ts_ms < seen - 600000, false) as late from m""",
    "alarm_m_of_n": f"""with {TRADES}, s as (select symbol, ts_ms - ts_ms % 3600000 as period_ms, sum((kind = 'error')::bigint)::bigint as total from trades group by all),
e as (select symbol, unnest(range(min(period_ms), max(period_ms) + 1, 3600000)) as period_ms from s group by symbol),
f as (select e.symbol, e.period_ms, coalesce(total, 0) as total from e left join s on s.symbol = e.symbol and s.period_ms = e.period_ms)
select *, (total >= 1)::int as breach, sum((total >= 1)::int) over (partition by symbol order by period_ms rows between 4 preceding and current row) >= 3 as alarm from f""",
    "counter_increases": f"""with {QUOTES}, w as (select *, seq % 1000 as c, lag(seq % 1000) over (partition by symbol order by seq) as p from quotes)
select symbol, seq, case when p is null or c < p then c else c - p end as gained from w""",
    "gate_all_pass": f"""with {TRADES}, r as (select symbol, arg_max(qty, trade_id) as p, count(*) as n from trades group by 1)
select count(*) as profiles, count(*) > 0 as loss_ok, coalesce(bool_and(p <= 60), false) as p99_ok, count(*) > 0 as resync_ok, coalesce(bool_and(n > 0), false) as signals_ok,
coalesce(bool_and(p <= 60), false) as passed from r""",
    "daily_partition_counts": f"with {TRADES} select symbol, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') as date, count(*) as n from trades group by all",
    "partition_value_norm": f"with p as (select p_partkey, {_NORM} as value from part) select p_partkey, value, printf('bookticker_%d_%s_%s_part-%06d.parquet', p_partkey * 1000, 'binance', value, p_partkey) as file_name, p_partkey as part_index from p",
    "object_keys": "select p_partkey, case when p_partkey % 2 = 0 then 'raw/a/b/' || p_partkey else 'raw/exchange=binance/symbol=btcusdt/date=2026-04-16/' || p_partkey end as object_key from part",
    "event_ids": f"with {UPDATES} select seq, 'binance:coinm:' || symbol || ':' || final_update_id as event_id, coalesce(case when seq % 3 > 0 then prev_final_update_id end, greatest(first_update_id - 1, 0)) as depth_update_pu from updates",
    "clock_offsets": f"with {QUOTES}, o as (select seq, trunc((o_custkey % 9 + 3 - o_custkey % 17) / 2)::bigint as offset_ms from quotes) select seq, offset_ms, greatest(seq + offset_ms, seq + 1) as recv_ms from o",
    "clock_slew_fold": """with recursive m as (select c_nationkey, floor(c_acctbal)::bigint as m, row_number() over (partition by c_nationkey order by c_custkey) as i from customer),
f(k, i, o) as (select distinct c_nationkey, 0::bigint, 0::bigint from m union all
 select k, m.i, o + greatest(-25, least(25, case when round(0.5::double * (m.m - o))::bigint = 0 and m.m <> o then sign(m.m - o)::bigint else round(0.5::double * (m.m - o))::bigint end))
 from f join m on m.c_nationkey = k and m.i = f.i + 1)
select k as c_nationkey, arg_max(o, i) as offset_ms from f group by 1""",
    "fifo_queue_closed_form": f"""with {CHANGES}, a as (select {_KEYS}, seq, size - was as size from changes where change in ('add', 'increase')),
g as (select {_KEYS}, sum(drop_) as removed from changes group by all),
u as (select a.*, sum(a.size) over (partition by a.symbol, a.is_bid, a.price order by seq) as upto, removed from a join g on g.symbol = a.symbol and g.is_bid = a.is_bid and g.price = a.price)
select {_KEYS}, seq, greatest(0, least(size, upto - removed)) as "left" from u where least(size, upto - removed) > 0""",
    "counts_by_symbol": f"with {TRADES} select symbol, count(*) as n, max(ts_ms) as last_ms from trades group by 1",
    "kernel_book": f"""with {KERNEL} select symbol, 'binance:coinm:' || symbol || ':' || rn * 10 as event_id, rn * 100 as event_ts_ms, rn * 10 as depth_update_u, rn * 10 - 10 as depth_update_pu,
false as stale_state, 'emit' as outcome, bb as best_bid, ba as best_ask, (bb + ba) / 2 as mid_price, round((ba - bb) / ((bb + ba) / 2) * 10000, 6) as spread_bps,
round((ba * bq + bb * aq) / (bq + aq), 6) as microprice, bids * 100 as bid_notional_5pct, asks * 100 as ask_notional_5pct, round((bids - asks) / (bids + asks), 9) as imbalance_5pct,
(case when bb = wbb then bq - wbq when bb > wbb then bq else -wbq end) - (case when ba = wba then aq - waq when ba < wba then aq else -waq end) as ofi_l1,
(bids - wbids) - (asks - wasks) as m_ofi_top5, s5 - unseen as cvd_5s, s60 - unseen as cvd_1m, s300 - unseen as cvd_5m, 0::bigint as ingest_to_signal_ms from kernel where rn > 1""",
    "kernel_counters": f"""with {KERNEL}, c as (select symbol, count(*) as trades, count(*) filter (rn > 1) as depth from kernel group by 1),
u as (select symbol, 'total_agg_trade_events' as name, trades as n from c union all select symbol, 'total_depth_events', depth from c union all select symbol, 'signals_emitted', depth from c)
select * from u where n > 0""",
    "kernel_keyframes": f"""with {KERNEL} select symbol, rn * 100 as snapshot_ts_ms, rn * 10 as last_update_id, 'local_keyframe' as snapshot_source, ({_SIZE('b')})::int as n_bids, ({_SIZE('a')})::int as n_asks,
bids as bid_size, asks as ask_size, bb as best_bid, ba as best_ask from kernel where rn % 10 = 1 and rn > 1""",
    "crossed_books": f"""with {MARKS} select symbol || '/' || bucket as symbol, max(price) filter (is_bid) as best_bid, min(price) filter (not is_bid) as best_ask,
coalesce(max(price) filter (is_bid) >= min(price) filter (not is_bid), false) as crossed from at_marks group by symbol, bucket""",
    "frame_routes": f"with {TRADES} select trade_id, case trade_id % 5 when 0 then 'depth' when 1 then 'quote' when 2 then 'trade' else 'bad' end as kind from trades",
    "trade_frames": f"with {TRADES} select symbol, trade_id, ts_ms as event_ts_ms, price, qty, buyer_is_maker from trades where kind <> 'error'",
    "quote_frames": f"with {QUOTES} select symbol, seq as update_id, case when seq % 2 = 1 then seq * 10 - 3 else seq * 10 end as event_ts_ms, bid, bid_qty, ask, ask_qty from quotes",
    "depth_frames": f"""with {QUOTES} select symbol, l.is_bid, l.price, l.size, seq * 10 - 9 as first_update_id, seq * 10 as final_update_id
from (select *, unnest([{{'is_bid': true, 'price': bid, 'size': bid_qty}}, {{'is_bid': false, 'price': ask, 'size': ask_qty}}, {{'is_bid': false, 'price': ask + 1, 'size': 0.0::double}}]) as l from quotes) where l.price > 0""",
    "snapshot_arrays": f"""with {QUOTES} select symbol, seq as last_update_id, (bid > 0)::int + (bid - 1 > 0)::int as n_bids, 1 as n_asks, bid, 0.0::double as second_size, ask_qty as ask_size,
2::bigint as n_loaded from quotes""",
    "gate_archive": """with f as (select 'P' || p_partkey % 5 as profile, (p_partkey // 5) % 7 as no from part where not (p_partkey % 5 = 4 and (p_partkey // 5) % 7 = 2))
select profile, bool_or(no = 0) as bookticker_manifest, bool_or(no = 1) as depth_delta_manifest, bool_or(no = 2) as snapshot_manifest, bool_or(no = 3) as bookticker_part,
bool_or(no = 4) as depth_delta_part, bool_or(no = 5) as snapshot_part, bool_or(no = 6) as metrics, count(distinct no) = 7 as passed from f group by 1""",
    "gate_upload": f"""with {TRADES} select user_id as profile, count(*) filter (kind = 'click') as verified, count(*) filter (kind = 'error') as failed,
count(*) filter (kind = 'click') > 0 and count(*) filter (kind = 'error') = 0 as passed from trades group by 1""",
    "log_reports": f"""with {QUOTES} select symbol as profile, arg_max(bid_qty / 8, seq) as loss_rate, max(seq)::double as p99_ms, arg_max(o_custkey, seq) as resync_started,
arg_max(o_custkey, seq) as resync_completed, max(seq) * 2 as signals_emitted from quotes where seq % 3 <> 0 group by 1""",
    "ntp_times": f"with {TRADES} select trade_id, (trade_id + 3913056000 - 2208988800) * 1000 + ((((trade_id * 2654435761) % 4294967296) * 1000) >> 32) as ms from trades",
    "avg_bbo_size": f"""with {QUOTES}, w as (select symbol, seq, q.bid_qty, q.ask_qty, datediff('day', date '1970-01-01', o_orderdate::date) as day from quotes q join orders on o_orderkey = seq)
select symbol, seq, count(*) over o as n_samples, round(avg((bid_qty + ask_qty) / 2) over o, 6) as avg_bbo from w
window o as (partition by symbol order by day range between 30 preceding and 1 preceding)""",
    "top5_flow_join": f"""with {MARKS}, r as (select *, row_number() over (partition by symbol, bucket, is_bid order by case when is_bid then -price else price end) as level from at_marks),
t as (select symbol, bucket, is_bid, price, size from r where level <= 5),
f as (select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.bucket, b.bucket + 1) as bucket, coalesce(a.is_bid, b.is_bid) as is_bid, coalesce(a.size, 0) - coalesce(b.size, 0) as gain
  from t a full join t b on a.symbol = b.symbol and a.bucket = b.bucket + 1 and a.is_bid = b.is_bid and a.price = b.price)
select symbol, bucket, sum(case when is_bid then gain else -gain end) as flow from f where (symbol, bucket) in (select (symbol, bucket) from marks) group by all""",
    "release_order": f"""with {TRADES}, {QUOTES.strip()}, u as (select symbol, 'trade' as kind, (ts_ms // 3600000) % 500 as ts_ms, trade_id as arrival_seq from trades
union all select symbol, 'depth', seq % 500, seq from quotes)
select *, row_number() over (partition by symbol order by ts_ms, kind <> 'trade', arrival_seq) as position from u""",
    "manifest_rows": """with m as (select l_partkey as k, count(*) as n from lineitem where l_quantity > 48 group by 1), every as (select k from m union select p_partkey from part)
select every.k as part_index, printf('snapshot_%d_x_y_part-%06d.parquet', every.k * 10, every.k) as file_name, coalesce(n, 0) as row_count, n is not null as uploaded from every left join m on m.k = every.k""",
    "expired_files": f"""with {QUOTES} select seq, 'metrics-binance-coinm-' || symbol || '-' || strftime(o_orderdate, '%Y-%m-%d') || '.jsonl' as file_name
from quotes join orders on o_orderkey = seq where o_orderdate::date < date '1997-01-01' - 30""",
    "jsonl_rows": "select source, count(*) as n_rows from (select source, unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> '' group by 1",
    "level_age": f"""with {CHANGES}, a as (select {_KEYS}, seq, day, size - was as size from changes where change in ('add', 'increase')),
g as (select {_KEYS}, sum(drop_) as removed from changes group by all),
u as (select a.*, sum(a.size) over (partition by a.symbol, a.is_bid, a.price order by seq) as upto, removed from a join g on g.symbol = a.symbol and g.is_bid = a.is_bid and g.price = a.price),
l as (select symbol, is_bid, greatest(0, 11000 - day) as age, least(size, upto - removed) as rest from u where least(size, upto - removed) > 0)
select symbol, is_bid, round(sum(rest * age) / sum(rest), 6) as age_days, sum(rest) as queued from l group by all""",
    "trade_attribution": f"""with {CHANGES}, {TRADES.strip()}, s as (select {_KEYS}, (ts_ms // 86400000) % 7 as bucket, sum(qty::decimal(28,9))::double as traded from trades group by all),
d as (select {_KEYS}, day % 7 as bucket, seq, drop_, sum(drop_) over (partition by {_KEYS}, day % 7 order by seq) as upto from changes where drop_ > 0),
e as (select d.*, greatest(0, least(drop_, coalesce(traded, 0) - (upto - drop_))) as executed from d left join s on s.symbol = d.symbol and s.is_bid = d.is_bid and s.price = d.price and s.bucket = d.bucket)
select {_KEYS}, bucket, seq, round(executed, 6) as executed, round(drop_ - executed, 6) as cancelled from e""",
    "concatenated_lines": f"""with {QUOTES}, k as (select *, unnest([1, 2]) as k from quotes where seq % 7 <> 0 and seq % 10 <> 0)
select symbol, seq * k as event_ts_ms, seq * k + 1 as recv_ts_ms, '{{}}' as raw_json, false as bad from k
union all select '', 0, 0, '', true from quotes where seq % 7 <> 0 and seq % 10 = 0""",
    "base_amounts": f"""with {QUOTES} select symbol, seq, round(case when bid > 0 and bid_qty > 0 then bid_qty else 0 end::double, 9) as linear,
round(case when bid > 0 and bid_qty > 0 then bid_qty * 100.0::double / bid else 0 end, 9) as inverse from quotes""",
    "chunk_starts": f"""with {QUOTES} select symbol, seq // 1000 as part, arg_min((seq * 7919) % 100000, seq) as start_ms, min((seq * 7919) % 100000) as least_ms, count(*) as n_rows
from quotes group by symbol, seq // 1000""",
    "type_names": """select p_partkey, 'nullable(' || replace(lower(p_brand), ' ', '') || ')' as kind,
regexp_full_match(case when p_partkey % 3 = 0 then p_name else 't_' || p_partkey end, '[A-Za-z0-9_]+') as is_identifier from part""",
    "queue_age_top5": f"""with {CHANGES}, a as (select {_KEYS}, seq, day, size - was as size from changes where change in ('add', 'increase')),
g as (select {_KEYS}, sum(drop_) as removed from changes group by all),
u as (select a.*, sum(a.size) over (partition by a.symbol, a.is_bid, a.price order by seq) as upto, removed from a join g on g.symbol = a.symbol and g.is_bid = a.is_bid and g.price = a.price),
l as (select {_KEYS}, sum(least(size, upto - removed)) as size, sum(least(size, upto - removed) * greatest(0, 11000 - day)) * 86400000 as aged from u where least(size, upto - removed) > 0 group by all),
r as (select *, row_number() over (partition by symbol, is_bid order by case when is_bid then -price else price end) as level from l),
s as (select symbol, coalesce(sum(aged) filter (is_bid) / sum(size) filter (is_bid), 0) as b, coalesce(sum(aged) filter (not is_bid) / sum(size) filter (not is_bid), 0) as a from r where level <= 5 group by 1)
select symbol, round(b, 3) as bid_age_ms, round(a, 3) as ask_age_ms, round(case when abs(b + a) > 1e-9 then (b - a) / (b + a) else 0 end, 9) as imbalance from s""",
}
