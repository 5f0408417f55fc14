"""The daily job on folders: named parts, upload, old line files, retention."""

import json
from datetime import UTC, date, datetime

import pytest

from lobspark.__main__ import arguments
from lobspark.config import Settings
from lobspark.schemas import DEPTH_DELTA, QUOTE_EVENT
from lobspark.sources import archive, daily

DAY = date(1970, 1, 2)
MS = 86_400_000


@pytest.fixture
def settings(tmp_path):
    return Settings.from_env({"APP_DATA_ROOT": str(tmp_path / "data"), "APP_S3_BUCKET": str(tmp_path / "store"), "APP_S3_PREFIX": "p", "APP_METRICS_RETENTION_DAYS": "3"})


def test_parts_are_named_listed_and_sent(spark, settings, tmp_path):
    rows = [(MS + i, MS + i, "binance", "coinm", "X", True, 1.0, 1.0, i, i, 1) for i in range(25)]
    df = spark.createDataFrame(rows, DEPTH_DELTA)
    home = archive.day_dir(settings.raw_spool_dir, "binance", settings.stream_symbol, DAY.isoformat())
    n = archive.spool(df, home, "depth-delta", "binance", "btcusd_perp", DAY.isoformat(), "recv_ts_ms", rows_per_file=10)
    more = archive.spool(df.limit(5), home, "depth-delta", "binance", "btcusd_perp", DAY.isoformat(), "recv_ts_ms", order="final_update_id")
    found = archive.parts(spark, home, "depth-delta").collect()
    assert [r["part_index"] for r in found] == list(range(1, n + more + 1)) and n >= 3
    assert found[0]["file_name"] == f"depth-delta_{MS}_binance_btcusd_perp_part-000001.parquet"
    listed = archive.read_manifest(spark, f"{home}/depth-delta_manifest.json").collect()
    assert sum(r["row_count"] for r in listed) == 30 and not any(r["uploaded"] for r in listed)
    (tmp_path / home / "depth-delta_0_binance_x_part-000099.tmp.parquet").write_text("unfinished")
    sent = daily.run_day(spark, settings, DAY)
    assert sent == {"depth-delta": n + more, "legacy_rows": 0, "metrics_rows": 0}
    place = archive.day_dir(settings.upload_target, "binance", "btcusd_perp", DAY.isoformat())
    assert place.endswith("store/p/exchange=binance/symbol=btcusd_perp/date=1970-01-02")
    assert spark.read.parquet(f"{place}/depth-delta_*.parquet").count() == 30
    assert [p.name for p in (tmp_path / home).iterdir() if not p.name.endswith(".crc")] == []
    assert daily.run_day(spark, settings, DAY) == {"legacy_rows": 0, "metrics_rows": 0}


def test_old_line_files(spark, settings, tmp_path):
    home = tmp_path / archive.day_dir(settings.raw_spool_dir, "binance", settings.stream_symbol, DAY.isoformat())
    home.mkdir(parents=True)
    row = json.dumps({"schema_version": 1, "symbol": "X", "event_ts_ms": 1, "recv_ts_ms": 2, "raw_json": "{}"})
    (home / "bookticker.jsonl").write_text(f"{row}{row}\n\n{row}{{\n{row}\n")
    assert daily.run_day(spark, settings, DAY)["legacy_rows"] == 3 and not (home / "bookticker.jsonl").exists()
    quotes = spark.createDataFrame([(1, 1, "X", "{}", 1)], QUOTE_EVENT)
    archive.spool(quotes, str(home), "bookticker", "binance", "btcusd_perp", DAY.isoformat(), "recv_ts_ms")
    (home / "bookticker.jsonl").write_text(row)
    assert "legacy_rows" not in daily.run_day(spark, settings, DAY)  # quote parts come before old files
    assert daily.run_day(spark, Settings(data_root=settings.data_root), DAY) == {}


def test_metrics_files(spark, settings, tmp_path):
    signals = spark.createDataFrame([(MS * d + i, float(i)) for d in (1, 2) for i in range(3)], "event_ts_ms long, mid_price double")
    for _ in range(2):  # a second export appends
        paths = daily.export_metrics(signals, settings)
    assert paths == [daily.metrics_path(settings, d) for d in ("1970-01-02", "1970-01-03")]
    lines = [json.loads(x)["event_ts_ms"] for x in open(paths[0])]
    assert lines == [MS, MS + 1, MS + 2] * 2
    (tmp_path / "data/metrics/metrics-1970-01-04.jsonl").write_text("{}\n\n{}\n")
    assert daily.upload_metrics(spark, settings, "1970-01-02") == 6 and daily.upload_metrics(spark, settings, "1970-01-04") == 2
    assert daily.upload_metrics(spark, settings, "1970-01-02") == 0
    (tmp_path / "data/metrics/metrics-x.jsonl").write_text("")
    assert daily.prune_metrics(spark, settings, date(1970, 1, 6)) == []
    assert daily.prune_metrics(spark, settings, date(1970, 1, 7)) == ["metrics-binance-coinm-btcusd_perp-1970-01-03.jsonl"]
    assert (tmp_path / "data/metrics/metrics-x.jsonl").exists()


def test_schedule(spark, settings, monkeypatch):
    assert daily.seconds_to_midnight(datetime(2026, 1, 1, 23, 59, 30, tzinfo=UTC)) == 30
    assert daily.seconds_to_midnight(datetime(2026, 1, 1, tzinfo=UTC)) == 86_400
    days, slept, told = [], [], []

    def run(spark, settings, day):
        days.append(day)
        if len(days) == 1:
            raise OSError("down")

    monkeypatch.setattr(daily, "run_day", run)
    daily.maintain(spark, settings, warn=told.append, now=lambda: datetime(2026, 1, 2, 12, tzinfo=UTC), sleep=slept.append, rounds=2)
    assert days == [date(2026, 1, 1)] * 2 and slept == [43_200] and told == ["upload failed: down"]


def test_command_line():
    today = date(2026, 1, 2)
    ask = lambda *a: arguments(list(a), today)
    assert ask("upload-once").day == today and ask("upload-once", "--yesterday").day == date(2026, 1, 1)
    assert ask("--config", "x", "upload-once", "--date", "2025-12-31").day == date(2025, 12, 31) and ask("maintain").job == "maintain"
    for bad in ([], ["upload-once", "--date", "x"], ["other"]):
        with pytest.raises(SystemExit):
            ask(*bad)


def test_profile_names(settings):
    read = Settings.from_env({"APP_REORDER_RESYNC_MAX_LAG_MS": "7", "APP_ENABLE_DEPTH_STREAM": "false", "APP_CLICKHOUSE_BATCH_SIZE": "9", "APP_S3_BUCKET": "b"})
    assert (read.reorder_resync_max_buffer_lag_ms, read.enable_depth_stream, read.batch_rows) == (7, False, 9)
    assert read.upload_target == "s3a://b/lobspark/binance/coinm" and Settings().upload_target == ""
    for bad in ({"APP_ENABLE_DEPTH_STREAM": "perhaps"}, {"APP_WS_RECONNECT_JITTER_BPS": "6000"}, {"APP_NTP_SLEW_ALPHA": "0"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)
