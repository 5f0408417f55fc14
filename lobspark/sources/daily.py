"""The daily job: finished days go to the object store, old metrics files go.

Works file by file through Hadoop's file system, so local folders and stores are alike.
A failed step raises; a repeated run takes up where it stopped.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.config import Settings
from lobspark.functions import names
from lobspark.sources import archive
from lobspark.sources.legacy import read_concatenated

#: The archive's datasets, in the order they are sent.
DATASETS = ["bookticker", "depth-delta", "snapshot"]


def seconds_to_midnight(now: datetime) -> float:
    """Until the next UTC midnight; never 0."""
    today = now.astimezone(UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    return (today + timedelta(days=1) - now).total_seconds()


def metrics_path(settings: Settings, date_key: str) -> str:
    return f"{settings.metrics_dir}/metrics-{settings.exchange}-{settings.market}-{settings.stream_symbol}-{date_key}.jsonl"


def export_metrics(signals: DataFrame, settings: Settings) -> list[str]:
    """Signals of one instrument appended to its line file of each day; returns the paths.

    Spark writes the lines; the files of a day are then strung together as bytes, the old
    content first, and renamed into place. Appends: exporting the same signals again
    repeats their lines.
    """
    spark = signals.sparkSession
    staged = f"{settings.metrics_dir}/staged-{uuid.uuid4().hex}"
    dated = signals.withColumn("p_date", names.date_key(F.col("event_ts_ms")))
    dated.repartitionByRange("event_ts_ms").sortWithinPartitions("event_ts_ms").write.partitionBy("p_date").json(staged)
    fs, top, of = archive._fs(spark, staged)
    conf, io, done = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.io.IOUtils, []
    for day in sorted(x.getPath().getName() for x in fs.globStatus(of(f"{staged}/p_date=*")) or []):
        path = metrics_path(settings, day.removeprefix("p_date="))
        pieces = [path] * fs.exists(of(path)) + sorted(x.getPath().toString() for x in fs.globStatus(of(f"{staged}/{day}/part-*")))
        out = fs.create(of(f"{path}.tmp"), True)
        for piece in pieces:
            source = fs.open(of(piece))
            io.copyBytes(source, out, conf, False)
            source.close()
        out.close()
        archive.replace(spark, f"{path}.tmp", path)
        done.append(path)
    fs.delete(top, True)
    return done


def upload_metrics(spark: SparkSession, settings: Settings, date_key: str) -> int:
    """Send a day's metrics file (its own name, else the old shared one) and delete it; returns its lines that are not blank."""
    own, old = metrics_path(settings, date_key), f"{settings.metrics_dir}/metrics-{date_key}.jsonl"
    found = next((p for p in (own, old) if archive.exists(spark, p)), None)
    if not found:
        return 0
    place = archive.day_dir(settings.upload_target, settings.exchange, settings.stream_symbol, date_key)
    archive.copy_verified(spark, found, f"{place}/metrics/metrics-{date_key}.jsonl")
    rows = spark.read.text(found).where(F.trim("value") != "").count()
    archive.remove(spark, found)
    return rows


def upload_legacy(spark: SparkSession, settings: Settings, date_key: str) -> int:
    """Turn a day's old line file into Parquet in the store, recount it, delete the source; returns the rows."""
    raw = archive.day_dir(settings.raw_spool_dir, settings.exchange, settings.stream_symbol, date_key) + "/bookticker.jsonl"
    if not archive.exists(spark, raw):
        return 0
    place = archive.day_dir(settings.upload_target, settings.exchange, settings.stream_symbol, date_key)
    good = read_concatenated(spark, raw).where("not bad").select("recv_ts_ms", "event_ts_ms", "symbol", "raw_json", "schema_version")
    good.write.mode("overwrite").parquet(f"{place}/bookticker.parquet")
    rows = spark.read.schema(good.schema).parquet(f"{place}/bookticker.parquet").count()
    if rows != good.count():
        raise OSError(f"{raw}: row counts differ after the conversion")
    archive.remove(spark, raw)
    return rows


def run_day(spark: SparkSession, settings: Settings, day: date) -> dict[str, int]:
    """Send one day: the parts of every dataset, old line files if there are no quote parts, the metrics file.

    Without a bucket everything stays where it is. Returns parts by dataset and rows of the line files.
    """
    if not settings.upload_target:
        return {}
    key, sent = day.isoformat(), {}
    home = archive.day_dir(settings.raw_spool_dir, settings.exchange, settings.stream_symbol, key)
    place = archive.day_dir(settings.upload_target, settings.exchange, settings.stream_symbol, key)
    quotes = False
    for dataset in DATASETS:
        manifest = f"{home}/{dataset}_manifest.json"
        if archive.exists(spark, home):
            archive.clean_unfinished(spark, home, dataset)
            there = archive.exists(spark, manifest) or not archive.parts(spark, home, dataset).isEmpty()
            quotes |= there and dataset == DATASETS[0]
            if there:
                sent[dataset] = archive.upload_day(spark, home, manifest, dataset, key, place, delete=True)
    if not quotes:
        sent["legacy_rows"] = upload_legacy(spark, settings, key)
    sent["metrics_rows"] = upload_metrics(spark, settings, key)
    return sent


def prune_metrics(spark: SparkSession, settings: Settings, today: date) -> list[str]:
    """Delete metrics files dated before today - retention_days; other files stay."""
    fs, _, of = archive._fs(spark, settings.metrics_dir)
    edge, gone = today - timedelta(days=settings.retention_days), []
    for status in fs.globStatus(of(f"{settings.metrics_dir}/metrics-*.jsonl")) or []:
        name = status.getPath().getName()
        try:
            dated = date.fromisoformat(name.removesuffix(".jsonl")[-10:])
        except ValueError:
            continue
        if dated < edge:
            fs.delete(status.getPath(), False)
            gone.append(name)
    return sorted(gone)


def maintain(
    spark: SparkSession,
    settings: Settings,
    *,
    warn: Callable[[str], None] = print,
    now: Callable[[], datetime] = lambda: datetime.now(UTC),
    sleep: Callable[[float], None] = time.sleep,
    rounds: int | None = None,
) -> None:
    """The day before, now and after every UTC midnight; failures are told and the next midnight tries again."""
    done = 0
    while rounds is None or done < rounds:
        if done:
            sleep(seconds_to_midnight(now()))
        today = now().astimezone(UTC).date()
        for what, job in (("upload", lambda d=today: run_day(spark, settings, d - timedelta(days=1))), ("retention", lambda d=today: prune_metrics(spark, settings, d))):
            try:
                job()
            except Exception as error:  # noqa: BLE001  one failed job must not end the others
                warn(f"{what} failed: {error}")
        done += 1
