"""Dates, partition values, file names and other text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(ms: Column) -> Column:
    """UTC day of epoch milliseconds; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def partition_value(c: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_\-]", "_")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").otherwise(cleaned)


def part_name(dataset: str, chunk_start: Column, exchange: Column, symbol: Column, index: Column) -> Column:
    return F.format_string(f"{dataset}_%d_%s_%s_part-%06d.parquet", chunk_start, exchange, symbol, index)


def part_index(name: Column) -> Column:
    """Index of a part's name, new or old style; null for others and for unfinished parts."""
    return F.regexp_extract(name, r"part-(\d+)\.parquet$", 1).try_cast("bigint")


def metrics_file_date(stem: Column) -> Column:
    return F.try_to_date(F.right(stem, F.lit(10)), "yyyy-MM-dd")


def relative_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def object_key(prefix: Column, exchange: Column, symbol: Column, date: Column, name: Column) -> Column:
    """Relative paths pass through; bare names go to exchange=/symbol=/date=."""
    place = F.format_string("exchange=%s/symbol=%s/date=%s/%s", exchange, symbol, date, name)
    tail = F.when(F.contains(relative_path(name), F.lit("/")), relative_path(name)).otherwise(place)
    return F.when(prefix == "", tail).otherwise(F.concat_ws("/", F.regexp_replace(prefix, "/+$", ""), tail))


def type_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "")


def valid_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_]+$")


def plain_log(line: Column) -> Column:
    """A log line without terminal colours."""
    return F.regexp_replace(line, r"\x1B\[[0-9;]*[A-Za-z]", "")


def log_value(line: Column, key: str) -> Column:
    """key=value of a log line; Some(n) is n."""
    raw = F.regexp_extract(line, rf"(?:^|\s){key}=(Some\([^)]*\)|\S+)", 1)
    return F.nullif(F.regexp_replace(raw, r"^Some\((.*)\)$", "$1"), F.lit(""))


def ntp_to_ms(seconds: Column, fraction: Column) -> Column:
    """64-bit fixed point since 1900 to epoch milliseconds."""
    return (seconds - 2_208_988_800) * 1000 + F.shiftright(fraction * 1000, 32)


def clock_offset(t1: Column, t2: Column, t3: Column, t4: Column) -> Column:
    """((t2 - t1) + (t3 - t4)) / 2, truncated toward zero."""
    twice = (t2 - t1) + (t3 - t4)
    return F.when(twice < 0, -F.floor(-twice / 2)).otherwise(F.floor(twice / 2)).cast("bigint")


def received_at(recv_ms: Column, offset_ms: Column, event_ts_ms: Column) -> Column:
    return F.greatest(recv_ms + offset_ms, event_ts_ms)


def slew(measures: Column, *, start: int = 0, alpha: float = 0.25, step: int = 25) -> Column:
    """Running clock offset after an array of measures: bounded steps, at least 1 when off."""

    def move(now: Column, m: Column) -> Column:
        delta = F.round(F.lit(alpha) * (m - now)).cast("bigint")
        least = F.when((delta == 0) & (m != now), F.signum(m - now).cast("bigint")).otherwise(delta)
        return now + F.greatest(F.lit(-step).cast("bigint"), F.least(F.lit(step).cast("bigint"), least))

    return F.aggregate(measures, F.lit(start).cast("bigint"), move)
