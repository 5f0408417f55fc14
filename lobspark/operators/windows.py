"""Rolling sums, level statistics, ranks and alarms as window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.functions.signals import QTY_EPS, signed_qty

CVD_WINDOWS = {"cvd_5s": 5_000, "cvd_1m": 60_000, "cvd_5m": 300_000}


def in_blocks(df: DataFrame, ts: str, reach_ms: int, block_ms: int) -> DataFrame:
    """df with ``__block`` and ``__own``: time blocks, each with the rows up to reach_ms before it.

    A range window of at most reach_ms, partitioned by the block as well, has the same frames
    on own rows; so one hot key is many tasks. Rows in a block's last reach_ms stand in the
    next one too, so blocks much longer than the reach copy little.
    """
    if block_ms < reach_ms:
        raise ValueError("a block must be at least as long as the window's reach")
    block = F.floor(F.col(ts) / block_ms)
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    nxt = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    copies = F.when(F.pmod(F.col(ts), F.lit(block_ms)) >= block_ms - reach_ms, F.array(own, nxt)).otherwise(F.array(own))
    return df.withColumn("__at", F.explode(copies)).withColumns({"__block": F.col("__at.block"), "__own": F.col("__at.own")}).drop("__at")


def _blocks(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / width))


def _carried(blocks: DataFrame, by: str, value: Column, over) -> DataFrame:
    """(by, __block, __carry): what over() makes of the values of the blocks before each one; one row a block."""
    ends = blocks.groupBy(by, "__block").agg(value.alias("__end"))
    w = Window.partitionBy(by).orderBy("__block")
    return ends.select(F.col(by).alias("__by"), F.col("__block").alias("__b"), over(F.col("__end"), w).alias("__carry"))


def _with_carry(df: DataFrame, by: str, carried: DataFrame) -> DataFrame:
    return df.join(carried, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__b")), "left").drop("__by", "__b", "__block")


def lagged(df: DataFrame, columns: list[str], out: str, *, by: str, order: str, width: int) -> DataFrame:
    """df with out: a struct of the columns of the row before, in order, null for the first.

    Rows are sorted in blocks of width of the order's values, and a block's first row gets the
    last one of the block before it. So a hot key is many tasks; only a row a block meets in one.
    """
    row = F.struct(*columns)
    blocks = _blocks(df, order, width)
    carried = _carried(blocks, by, F.max_by(row, order), lambda end, w: F.lag(end).over(w))
    own = F.lag(row).over(Window.partitionBy(by, "__block").orderBy(order))
    return _with_carry(blocks.withColumn(out, own), by, carried).withColumn(out, F.coalesce(out, "__carry")).drop("__carry")


def running_max(df: DataFrame, value: Column, out: str, *, by: str, order: str, width: int) -> DataFrame:
    """df with out: the greatest value of the rows before, in blocks as in lagged."""
    blocks = _blocks(df, order, width)
    sofar = lambda end, w: F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = _carried(blocks, by, F.max(value), sofar)
    own = F.max(value).over(Window.partitionBy(by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return _with_carry(blocks.withColumn(out, own), by, carried).withColumn(out, F.greatest(out, "__carry")).drop("__carry")


def numbered(df: DataFrame, out: str, *, by: str, order: str, ties: list[Column | str], width: int) -> DataFrame:
    """df with out: the place of each row by order and ties, from 1, in blocks as in lagged."""
    blocks = _blocks(df, order, width)
    sofar = lambda end, w: F.sum(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = _carried(blocks, by, F.count(F.lit(1)), sofar)
    own = F.row_number().over(Window.partitionBy(by, "__block").orderBy(order, *ties))
    placed = _with_carry(blocks.withColumn(out, own), by, carried)
    return placed.withColumn(out, (F.col(out) + F.coalesce("__carry", F.lit(0))).cast("int")).drop("__carry")


def sliding_sum(value: Column, keys: list[str], ts: str, first: int, last: int) -> Column:
    """Sum of value over ts - first .. ts - last, as the difference of two sums that only grow.

    Spark adds each row once to a growing frame, but all rows of a sliding one again for every
    row. value must be exact (whole or decimal), or differences would not be.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    upto = lambda end: F.coalesce(F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    return upto(-last) - upto(-first - 1)


def moments(value: Column, keys: list[str], ts: str, first: int, last: int) -> tuple[Column, Column, Column]:
    """(count, mean, population sigma) of value over ts - first .. ts - last; null values don't count.

    Sums are of nine decimal places, those of squares of twelve (values of six).
    """
    n = sliding_sum(F.when(value.isNotNull(), 1).otherwise(0).cast("long"), keys, ts, first, last)
    total = sliding_sum(value.cast("decimal(28,9)"), keys, ts, first, last).cast("double")
    six = value.cast("decimal(19,6)")
    squares = sliding_sum((six * six).cast("decimal(38,12)"), keys, ts, first, last).cast("double")
    some = F.when(n > 0, n)
    spread = F.sqrt(F.greatest(F.lit(0.0), some * squares - total * total)) / some
    return n, total / some, spread


def cvd(trades: DataFrame, windows: dict[str, int] = CVD_WINDOWS, by: str = "symbol", block_ms: int | None = None) -> DataFrame:
    """trades with rolling signed-volume sums; a window's lower edge is inclusive.

    Symbols are split into time blocks of 64 times the longest window (or block_ms).
    """
    reach = max(windows.values())
    columns = trades.columns
    trades = in_blocks(trades.where("ts_ms is not null"), "ts_ms", reach, block_ms or 64 * reach)
    signed = signed_qty(F.col("buyer_is_maker"), F.col("qty"))
    signed = F.when(F.abs(signed) > QTY_EPS, signed).otherwise(0.0)
    exact = signed.cast("decimal(28,9)")
    for name, ms in windows.items():
        total = sliding_sum(exact, [by, "__block"], "ts_ms", ms, 0).cast("double")
        trades = trades.withColumn(name, F.when(F.abs(total) <= QTY_EPS, 0.0).otherwise(total))
    return trades.where("__own").select(*columns, *windows)


def buckets(trades: DataFrame, width_ms: int = 100, by: tuple[str, ...] = ("symbol", "is_bid", "price")) -> DataFrame:
    """Traded quantity by tumbling bucket, which begins at a multiple of the width."""
    start = (F.col("ts_ms") - F.pmod("ts_ms", F.lit(width_ms))).alias("bucket_ms")
    total = F.sum(F.col("qty").cast("decimal(28,9)")).cast("double").alias("qty")
    return trades.groupBy(*by, start).agg(total, F.count("*").alias("n_trades"))


def level_stats(samples: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """samples (symbol, is_bid, price, ts_ms, seq, size) with mean, population sigma and mu + 2 sigma of earlier ones."""
    keys = ["symbol", "is_bid", "price", "__block"]
    kept = in_blocks(samples.where(F.col("size") > QTY_EPS), "ts_ms", window_ms, 64 * window_ms)
    n, mean, sigma = moments(F.col("size"), keys, "ts_ms", window_ms, 1)
    kept = kept.withColumns({"n_samples": n, "mean_size": mean, "sigma_size": sigma}).where("__own").drop("__own", "__block")
    return kept.withColumn("threshold", F.when(F.col("n_samples") >= 2, F.col("mean_size") + 2 * F.col("sigma_size")))


def average_bbo(quotes: DataFrame, window_ms: int = 60_000, by: str = "symbol") -> DataFrame:
    """quotes with the mean of (bid_qty + ask_qty) / 2 over the samples before each; null without any."""
    sample = (F.col("bid_qty") + F.col("ask_qty")) / 2
    sample = F.when(sample > QTY_EPS, sample)
    n, mean, _ = moments(sample, [by, "__block"], "ts_ms", window_ms, 1)
    blocks = in_blocks(quotes, "ts_ms", window_ms, 64 * window_ms)
    return blocks.withColumns({"n_samples": n, "avg_bbo": mean}).where("__own").drop("__own", "__block")


def nearest_rank(df: DataFrame, by: list[str], value: str, order: list[str], q: float = 0.99, last: int = 20_000) -> DataFrame:
    """Exact nearest-rank quantile of the last samples of each group: index round((n - 1) q) of the sorted values."""
    recent = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    held = df.withColumn("__age", recent).where(F.col("__age") <= last)
    w = Window.partitionBy(*by)
    ranked = held.withColumns({"__n": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(value, *order)) - 1})
    at = F.floor((F.col("__n") - 1) * q + 0.5)
    return ranked.where(F.col("__r") == at).select(*by, F.col(value).alias("p"), F.col("__n").alias("n"))


def m_of_n(events: DataFrame, *, ts: str, value: str, by: list[str], period_ms: int, limit: float, m: int = 3, n: int = 5) -> DataFrame:
    """Tumbling sums, empty periods filled in with 0, and an alarm where m of the last n reach limit."""
    start = (F.col(ts) - F.pmod(ts, F.lit(period_ms))).alias("period_ms")
    sums = events.groupBy(*by, start).agg(F.sum(value).alias("total"))
    ends = sums.groupBy(*by).agg(F.min("period_ms").alias("a"), F.max("period_ms").alias("b"))
    every = ends.select(*by, F.explode(F.sequence("a", "b", F.lit(period_ms))).alias("period_ms"))
    filled = every.join(sums, [*by, "period_ms"], "left").fillna(0, ["total"])
    breach = (F.col("total") >= limit).cast("int")
    w = Window.partitionBy(*by).orderBy("period_ms").rowsBetween(-(n - 1), 0)
    return filled.withColumns({"breach": breach, "alarm": F.sum(breach).over(w) >= m})


def counter_increase(df: DataFrame, counter: str, by: list[str], order: str) -> Column:
    """What a cumulative counter gained since the row before; a restart counts from 0."""
    was = F.lag(counter).over(Window.partitionBy(*by).orderBy(order))
    now = F.col(counter)
    return F.when(was.isNull() | (now < was), now).otherwise(now - was)
