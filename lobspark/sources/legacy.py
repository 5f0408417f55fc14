"""Old line files: a line may hold several JSON objects one after another."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = "schema_version int, symbol string, event_ts_ms long, recv_ts_ms long, raw_json string, bad boolean"


def parse_concatenated(lines: DataFrame) -> DataFrame:
    """(value) lines to rows of all objects; a line with anything unreadable gives one row with bad true, blank lines none.

    Spark's own JSON reader keeps only the first object of such a line.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for batch in batches:
            out = []
            for line in batch["value"].to_pylist():
                text, at, found = (line or "").strip(), 0, []
                try:
                    while at < len(text):
                        item, at = decoder.raw_decode(text, at)
                        found.append((int(item["schema_version"]), item["symbol"], int(item["event_ts_ms"]), int(item["recv_ts_ms"]), item["raw_json"], False))
                        while at < len(text) and text[at].isspace():
                            at += 1
                except (ValueError, KeyError, TypeError):
                    found = [(None, None, None, None, None, True)]
                out += found
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = ["schema_version", "symbol", "event_ts_ms", "recv_ts_ms", "raw_json", "bad"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return lines.select("value").mapInArrow(parse, ROWS)


def read_concatenated(spark: SparkSession, path: str) -> DataFrame:
    return parse_concatenated(spark.read.text(path))
