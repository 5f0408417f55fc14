"""The live feed: connectors, back-off, retry, and a Python data source that replays frames.

The exchange's socket is one connector; without a network the replay connector stands in.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class Connector(Protocol):
    """What an exchange must offer: frames after an offset, and a snapshot of the book."""

    def frames(self, after: int, limit: int) -> list[tuple[int, int, str]]: ...

    def snapshot(self, symbol: str, depth: int) -> str: ...


class ReplayConnector:
    """Frames from a file with one (recv_ts_ms, frame) JSON array a line."""

    def __init__(self, path: str):
        self.path = path

    def frames(self, after: int, limit: int) -> list[tuple[int, int, str]]:
        out = []
        with open(self.path) as f:
            for i, line in enumerate(f):
                if i >= after + limit:
                    break
                if i >= after:
                    recv, frame = json.loads(line)
                    out.append((i, recv, frame))
        return out

    def snapshot(self, symbol: str, depth: int) -> str:
        with open(f"{self.path}.snapshot") as f:
            return f.read()


CONNECTORS: dict[str, Callable[..., Connector]] = {"replay": ReplayConnector}


def register(name: str, make: Callable[..., Connector]) -> None:
    CONNECTORS[name.strip().lower()] = make


def connector(name: str, **options) -> Connector:
    if name.strip().lower() not in CONNECTORS:
        raise ValueError(f"no connector for {name!r}")
    return CONNECTORS[name.strip().lower()](**options)


def back_off(attempts: int, *, first: float = 1.0, most: float = 30.0, jitter_bps: int = 1000, draw: Callable[[], float] = random.random) -> Iterator[float]:
    """Seconds to wait before each new attempt: doubled up to most, spread by the jitter, 0.1 at least."""
    wait = first
    for _ in range(attempts):
        yield max(0.1, wait * (1 + (2 * draw() - 1) * jitter_bps / 10_000))
        wait = min(most, wait * 2)


def fetch_snapshot(feed: Connector, symbol: str, depth: int = 1000, attempts: int = 5, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> str:
    for left in reversed(range(attempts)):
        try:
            return feed.snapshot(symbol, depth)
        except OSError:
            if not left:
                raise
            sleep(pause)
    raise AssertionError


class FrameReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.feed = connector(options.get("connector", "replay"), path=options["path"])
        self.limit = int(options.get("maxFrames", "10000"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self.feed.frames(start["at"], self.limit)
        return iter(found), {"at": start["at"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self.feed.frames(start["at"], end["at"] - start["at"]))

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """``spark.dataSource.register(FrameSource)``, then ``readStream.format("lob_frames")``."""

    @classmethod
    def name(cls) -> str:
        return "lob_frames"

    def schema(self) -> str:
        return "arrival_seq long, recv_ts_ms long, value string"

    def simpleStreamReader(self, schema) -> FrameReader:  # noqa: N802
        return FrameReader(self.options)
