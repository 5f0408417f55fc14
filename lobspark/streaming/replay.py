"""The kernel on a stream: one keyed state machine a symbol, fed in arrival order.

State is the kernel itself, kept as one value a symbol: one read and one write a
micro-batch. Keyframes leave it with the batch that made them. Release happens event by
event, so micro-batch borders change nothing; an event of kind 'end' releases what waits.
"""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lobspark.config import Settings
from lobspark.operators.kernel import Kernel
from lobspark.plans.replay import KERNEL_OUT, plain, signals_of, tagged

_ROW = T.StructType([T.StructField("row", T.StringType())])


def wall_clock() -> float:
    return time.time() * 1000


class ReplayProcessor(StatefulProcessor):
    """transformWithStateInPandas processor; the key is the symbol. Rows are KERNEL_OUT as JSON."""

    def __init__(self, settings: Settings, clock: Callable[[], float] | None):
        self.settings, self.clock = settings, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kernel", T.StructType([T.StructField("blob", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        kernel = pickle.loads(self.state.get()[0]) if self.state.exists() else Kernel(self.settings)
        kernel.clock = self.clock
        # the order of rows within a micro-batch is not promised
        batch = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        out = [x for r in batch.to_dict("records") for x in kernel.feed(plain(r))]
        told = tagged(kernel, key[0], out, totals=True)
        kernel.clock = None
        self.state.update((pickle.dumps(kernel),))
        yield pd.DataFrame({"row": [json.dumps(r) for r in told]})

    def close(self) -> None:
        pass


def stream_outputs(events: DataFrame, settings: Settings, *, clock: Callable[[], float] | None = wall_clock) -> DataFrame:
    """Outputs (KERNEL_OUT) of a stream of unified events: signals, keyframes, and the counters so far with
    every micro-batch. Latencies are told by clock, None for replays. Needs the RocksDB state store."""
    out = events.groupBy("symbol").transformWithStateInPandas(
        ReplayProcessor(settings, clock), outputStructType=_ROW, outputMode="append", timeMode="none"
    )
    return out.select(F.from_json("row", KERNEL_OUT).alias("r")).select("r.*")


def stream_signals(events: DataFrame, settings: Settings, *, clock: Callable[[], float] | None = wall_clock) -> DataFrame:
    """Signals of a stream of unified events."""
    return signals_of(stream_outputs(events, settings, clock=clock))
