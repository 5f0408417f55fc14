"""Rows packed into compressed chunks of a bounded size, for operators that read texts more than once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lobspark.llm import tokens as tk


#: A chunk is cut when this many times its bytes are held, so that no small rest is left behind.
AHEAD = 1.25


def _cut(held: list[pa.RecordBatch], size: int, most: int) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch], int]:
    """The batches of a chunk of about most bytes, those after it and their bytes; a row is never divided."""
    out, done = [], 0
    for k, batch in enumerate(held):
        lengths = np.cumsum(batch["bytes"].to_numpy(zero_copy_only=False))
        if done + int(lengths[-1]) < most:
            out.append(batch)
            done += int(lengths[-1])
            continue
        end = int(np.searchsorted(lengths, most - done)) + 1
        done += int(lengths[end - 1])
        rest = [batch.slice(end)] if end < batch.num_rows else []
        return [*out, batch.slice(0, end)], rest + held[k + 1 :], size - done
    return out, [], 0


def pack_chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, blob): rows in the order they are read, in compressed tables of about chunk_bytes; ``bytes`` tells a row's.

    A chunk is named by a hash of what it holds, so a lost one comes back under its name;
    chunks that hold the same rows share a name and are then one group.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(part).drop_columns("bytes").combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            blob = sink.getvalue().to_pybytes()
            name = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(batch["bytes"].to_numpy(zero_copy_only=False).sum())
            while size >= AHEAD * chunk_bytes:
                part, held, size = _cut(held, size, chunk_bytes)
                yield out(part)
        if held:
            yield out(held)
        tk.release()

    return rows.mapInArrow(pack, "chunk long, blob binary")


def unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in table["blob"].to_pylist()).combine_chunks()
