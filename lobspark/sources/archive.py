"""The archive: partitioned Parquet, part discovery, manifests, deduplicated views, retention, export.

Datasets share a directory, as <dataset>_*_part-*.parquet under exchange=/symbol=/date=.
Files are listed and moved through Hadoop's file system, so any store works.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.functions import names
from lobspark.operators.sequence import first_seen, latest, orphans
from lobspark.schemas import MANIFEST, contract_errors


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def with_partitions(df: DataFrame, ts: str) -> DataFrame:
    """Partition columns beside the data's own: p_exchange, p_symbol (cleaned) and p_date (UTC day of ts)."""
    return df.withColumns(
        {"p_exchange": names.partition_value(F.col("exchange")), "p_symbol": names.partition_value(F.col("symbol")), "p_date": names.date_key(F.col(ts))}
    )


def write(df: DataFrame, path: str, ts: str, *, rows_per_file: int = 10_000, mode: str = "append") -> None:
    """Batch sink. The commit protocol makes files visible only when whole; a partition's rows meet in few tasks."""
    parts = ["p_exchange", "p_symbol", "p_date"]
    out = with_partitions(df, ts).hint("rebalance", *parts)  # large partitions are split, small ones share a task
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*parts).parquet(path)


def stream_to(df: DataFrame, path: str, ts: str, checkpoint: str):
    """Streaming sink of the same layout; its log takes the manifest's place."""
    parts = ["p_exchange", "p_symbol", "p_date"]
    out = with_partitions(df, ts)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*parts).trigger(availableNow=True).start()


def write_jsonl(df: DataFrame, path: str, ts: str = "event_ts_ms") -> None:
    df.withColumn("p_date", names.date_key(F.col(ts))).write.mode("append").partitionBy("p_date").json(path)


def parts(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(file_name, path, bytes, part_index) of a dataset's finished parts, one row a name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{dataset}*part-*.parquet").option("recursiveFileLookup", "true").load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.col("length").alias("bytes"))
    found = found.withColumn("part_index", names.part_index(F.col("file_name"))).where("part_index is not null")
    return first_seen(found, ["file_name"], "path").orderBy("part_index")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a manifest; none if the file is absent, an error if it is corrupt."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return None
    m = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return m.select(F.explode("parts").alias("p")).select("p.*")


def replace(spark: SparkSession, source: str, path: str) -> None:
    """Rename source over path in one step."""
    fs, p, of = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(of(source)), fs.makeQualified(p), over)


def put_manifest(spark: SparkSession, path: str, date_key: str, rows: list[dict]) -> None:
    """Write beside, then rename over it: readers see the old or the new manifest."""
    listed = sorted(rows, key=lambda r: r["part_index"])
    nxt = max([r["part_index"] for r in listed], default=0) + 1
    text = json.dumps({"schema_version": 1, "date_key": date_key, "next_part_index": nxt, "parts": listed})
    fs, _, of = _fs(spark, path)
    out = fs.create(of(f"{path}.tmp"), True)
    out.write(bytearray(text.encode()))
    out.close()
    replace(spark, f"{path}.tmp", path)


def save_manifest(spark: SparkSession, path: str, date_key: str, rows: DataFrame) -> None:
    """The manifest of one symbol and day: a row a part."""
    put_manifest(spark, path, date_key, [r.asDict() for r in rows.select("part_index", "file_name", "row_count", "uploaded").collect()])


def reconcile(found: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """The manifest's parts plus found ones it lacks (row count unknown: 0, not uploaded)."""
    fresh = found.select("part_index", "file_name", F.lit(0).cast("long").alias("row_count"), F.lit(False).alias("uploaded"))
    if manifest is None:
        return fresh
    return manifest.select("part_index", "file_name", "row_count", "uploaded").unionByName(orphans(fresh, manifest))


def deduplicated(signals: DataFrame) -> DataFrame:
    """The read view: of each (symbol, event_id) the row received last."""
    return latest(signals, ["symbol", "event_id"], "recv_ts_ms")


def first_only(signals: DataFrame) -> DataFrame:
    return first_seen(signals, ["event_id"], "recv_ts_ms")


def create_table(spark: SparkSession, table: str, df: DataFrame) -> None:
    """Create or widen a table: columns it lacks are added, then the contract is checked."""
    if not table.replace(".", "_").replace("_", "a").isalnum():
        raise ValueError(f"{table!r} is not an identifier")
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")
    have = {c.name for c in spark.catalog.listColumns(table)}
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in have]
    if more:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(more)})")
    errors = contract_errors(spark.table(table).schema, df.schema)
    if errors:
        raise ValueError("; ".join(errors))


def upsert_batch(table: str, keys: list[str], day: str | None = None):
    """foreachBatch sink that leaves out keys the table has and keeps the first of each batch; safe to repeat.

    day: a partition column that equal keys share; then only the batch's days of the table are read.
    """

    def write_batch(batch: DataFrame, _: int) -> None:
        old = batch.sparkSession.table(table)
        columns = old.columns  # the insert goes by position
        if day:
            low, high = batch.agg(F.min(day), F.max(day)).first()
            old = old.where(F.col(day).between(low, high))
        fresh = batch.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
        fresh.select(*columns).write.mode("append").insertInto(table)

    return write_batch


def expired(listing: DataFrame, today: Column, days: int) -> DataFrame:
    """Files (file_name) whose date lies before today - days."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return listing.where(names.metrics_file_date(stem) < F.date_sub(today, days))


def prune(spark: SparkSession, path: str, today: date, days: int) -> list[str]:
    """Delete p_date partitions before today - days, however deep below path; returns their names."""
    fs, p, _ = _fs(spark, path)
    edge, gone, folders = (today - timedelta(days=days)).isoformat(), set(), [p]
    while folders:
        for status in fs.listStatus(folders.pop()):
            name = status.getPath().getName()
            if not status.isDirectory():
                continue
            if not name.startswith("p_date="):
                folders.append(status.getPath())
            elif name.removeprefix("p_date=") < edge:
                fs.delete(status.getPath(), True)
                gone.add(name)
    return sorted(gone)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def copy_verified(spark: SparkSession, source: str, target: str) -> int:
    """Copy a file to any store and compare sizes; returns the bytes."""
    src_fs, src, _ = _fs(spark, source)
    dst_fs, dst, _ = _fs(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(src_fs, src, dst_fs, dst, False, True, spark._jsc.hadoopConfiguration())
    size = src_fs.getFileStatus(src).getLen()
    if dst_fs.getFileStatus(dst).getLen() != size:
        raise OSError(f"{target}: sizes differ after the copy")
    return size


def day_dir(top: str, exchange: str, symbol: str, date_key: str) -> str:
    clean = lambda v: re.sub(r"[^a-z0-9_\-]", "_", v.strip().lower()) or "unknown"
    return f"{top}/exchange={clean(exchange)}/symbol={clean(symbol)}/date={date_key}"


def spool(df: DataFrame, home: str, dataset: str, exchange: str, symbol: str, date_key: str, ts: str, *, order: str | None = None, rows_per_file: int = 10_000) -> int:
    """Rows of one symbol and day as named parts after those there are, listed in the manifest; returns how many.

    Spark writes the files beside; each is renamed into place with the time of its first
    row. Parts whose renaming is not followed by the manifest are found by ``reconcile``.
    """
    spark, order, staged = df.sparkSession, order or ts, f"{home}/staged-{uuid.uuid4().hex}"
    df.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", rows_per_file).parquet(staged)
    files = spark.read.schema(df.schema).parquet(staged).select(F.col(ts).alias("ts"), F.col(order).alias("at"), F.col("_metadata.file_path").alias("path"))
    files = files.groupBy("path").agg(F.min_by("ts", "at").alias("start"), F.count("*").alias("n")).orderBy("path").collect()
    manifest = f"{home}/{dataset}_manifest.json"
    rows = [r.asDict() for r in reconcile(parts(spark, home, dataset), read_manifest(spark, manifest)).collect()]
    first = max([r["part_index"] for r in rows], default=0) + 1
    fs, _, of = _fs(spark, home)
    for i, f in enumerate(files, first):
        name = f"{dataset}_{f['start']}_{exchange}_{symbol}_part-{i:06d}.parquet"
        if not fs.rename(of(f["path"]), of(f"{home}/{name}")):
            raise OSError(f"{name}: could not be put in place")
        rows.append({"part_index": i, "file_name": name, "row_count": f["n"], "uploaded": False})
    put_manifest(spark, manifest, date_key, rows)
    remove(spark, staged)
    return len(files)


def clean_unfinished(spark: SparkSession, home: str, dataset: str) -> list[str]:
    """Delete parts that a stopped writer left unfinished; returns their names."""
    fs, _, of = _fs(spark, home)
    gone = []
    for status in fs.globStatus(of(f"{home}/{dataset}*part-*.tmp.parquet")) or []:
        fs.delete(status.getPath(), False)
        gone.append(status.getPath().getName())
    return sorted(gone)


def upload_day(spark: SparkSession, path: str, manifest_path: str, dataset: str, date_key: str, target: str, *, delete: bool = False) -> int:
    """Copy a day's parts to the folder target in order of index, check sizes, mark them, then delete if asked.

    A listed part that is missing is an error. Returns the number of parts copied.
    """
    found = parts(spark, path, dataset)
    rows = [r.asDict() for r in reconcile(found, read_manifest(spark, manifest_path)).orderBy("part_index").collect()]
    here, done = {r["file_name"]: r["path"] for r in found.collect()}, 0
    for r in rows:
        if not r["uploaded"]:
            if r["file_name"] not in here:
                raise FileNotFoundError(r["file_name"])
            copy_verified(spark, here[r["file_name"]], f"{target}/{r['file_name']}")
            r["uploaded"] = True
            done += 1
            put_manifest(spark, manifest_path, date_key, rows)
        if delete and r["file_name"] in here:
            remove(spark, here[r["file_name"]])
    if delete and all(r["uploaded"] for r in rows):
        remove(spark, manifest_path)
    return done
