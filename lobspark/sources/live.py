"""The live feed: a WebSocket client, a collector that reconnects for ever, and frames landed as files.

The collector is one process a feed, outside Spark: it only receives and lands. Files of
frames are what ``streaming.jobs.read_frames`` reads, so a restart of either side loses
nothing that was landed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
import time
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from lobspark.config import Settings
from lobspark.sources.feed import back_off
from lobspark.sources.frames import stream_path

#: Fixed values of the protocol: the key's suffix and the frame types.
_SUFFIX = b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
CONTINUED, TEXT, BINARY, CLOSE, PING, PONG = 0, 1, 2, 8, 9, 10


class WebSocket:
    """The client's side of one connection. Any wait longer than idle_s raises TimeoutError."""

    def __init__(self, url: str, idle_s: float):
        at = urlsplit(url)
        secure = at.scheme == "wss"
        port = at.port or (443 if secure else 80)
        raw = socket.create_connection((at.hostname, port), timeout=idle_s)
        self.socket = ssl.create_default_context().wrap_socket(raw, server_hostname=at.hostname) if secure else raw
        self.file = self.socket.makefile("rb")
        key = base64.b64encode(os.urandom(16))
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        lines = [f"GET {path} HTTP/1.1", f"Host: {at.hostname}:{port}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key.decode()}", "Sec-WebSocket-Version: 13"]
        self.socket.sendall("\r\n".join([*lines, "", ""]).encode())
        status = self.file.readline()
        headers = {}
        while (line := self.file.readline().strip()) and b":" in line:
            name, value = line.split(b":", 1)
            headers[name.strip().lower()] = value.strip()
        accepted = base64.b64encode(hashlib.sha1(key + _SUFFIX).digest())
        if b" 101 " not in status or headers.get(b"sec-websocket-accept") != accepted:
            self.close()
            raise ConnectionError(f"no websocket at {url}: {status!r}")

    def _read(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) < n:
            raise ConnectionError("the connection ended inside a frame")
        return data

    def send(self, kind: int, data: bytes) -> None:
        mask = os.urandom(4)
        size = struct.pack("!BB", 128 | kind, 128 | len(data)) if len(data) < 126 else struct.pack("!BBH", 128 | kind, 254, len(data))
        self.socket.sendall(size + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """(type, data) of whole messages until the peer closes; pings are answered."""
        kind, parts = TEXT, []
        while True:
            first = self.file.read(1)
            if not first:
                return
            size = self._read(1)[0] & 127
            if size > 125:
                size = int.from_bytes(self._read(2 if size == 126 else 8), "big")
            op, data = first[0] & 15, self._read(size)
            if op == CLOSE:
                return
            if op == PING:
                self.send(PONG, data)
            if op > 7:
                continue
            kind, parts = (kind, parts) if op == CONTINUED else (op, [])
            parts.append(data)
            if first[0] & 128:
                yield kind, b"".join(parts)
                parts = []

    def close(self) -> None:
        self.file.close()
        self.socket.close()


class FrameFiles:
    """Frames as lines [arrival_seq, recv_ts_ms, frame] in files that appear when they are whole.

    A file is finished after most rows or flush_s seconds. Numbers go on where the folder's
    files end.
    """

    def __init__(self, folder: str, *, rows: int = 500, flush_s: float = 0.5, now: Callable[[], float] = time.time):
        self.folder, self.rows, self.flush_s, self.now = folder, rows, flush_s, now
        os.makedirs(folder, exist_ok=True)
        ends = [sum(map(int, f[7:-4].split("-"))) for f in os.listdir(folder) if f.startswith("frames-") and f.endswith(".txt")]
        self.next, self.held, self.since = max(ends, default=0), [], now()

    def put(self, frame: str) -> None:
        self.held.append(json.dumps([str(self.next + len(self.held)), str(int(self.now() * 1000)), frame]))
        if len(self.held) >= self.rows or self.now() - self.since >= self.flush_s:
            self.flush()

    def flush(self) -> None:
        if self.held:
            name = f"{self.folder}/frames-{self.next:012d}-{len(self.held):06d}.txt"
            with open(f"{name}.tmp", "w") as f:
                f.write("\n".join(self.held) + "\n")
            os.replace(f"{name}.tmp", name)
            self.next += len(self.held)
        self.held, self.since = [], self.now()


def collect(
    connect: Callable[[], WebSocket],
    land: FrameFiles,
    *,
    most_wait_s: float = 30.0,
    jitter_bps: int = 1000,
    stop: Callable[[], bool] = lambda: False,
    sleep: Callable[[float], None] = time.sleep,
) -> Counter:
    """Receive until stop; returns what happened how often.

    A connection ends by a close, an error or silence; then comes a wait that doubles up to
    most_wait_s and begins anew after each connection that was made. Only text messages are
    landed; frames that can't be read are told apart later, by ``frames.route``.
    """
    told: Counter = Counter()
    fresh = lambda: back_off(2**62, most=most_wait_s, jitter_bps=jitter_bps)
    waits = fresh()
    while not stop():
        told["ws_connect_attempts"] += 1
        try:
            feed = connect()
        except OSError:
            told["ws_connect_failures"] += 1
        else:
            told["ws_connected"] += 1
            waits = fresh()
            try:
                for kind, data in feed.messages():
                    if kind == TEXT:
                        try:
                            land.put(data.decode())
                            told["frames"] += 1
                        except UnicodeDecodeError:
                            told["not_utf8"] += 1
                    if stop():
                        break
                else:
                    told["ws_closed"] += 1
            except TimeoutError:
                told["ws_idle_timeouts"] += 1
            except OSError:
                told["ws_read_errors"] += 1
            finally:
                feed.close()
                land.flush()
        if not stop():
            told["ws_reconnects_scheduled"] += 1
            sleep(next(waits))
    return told


def run(settings: Settings, folder: str, **options) -> Counter:
    """Collect the streams that settings ask for."""
    if not settings.ws_base_url:
        raise ValueError("APP_WS_BASE_URL tells where the live feed is")
    on = {"depth": settings.enable_depth_stream, "quotes": settings.enable_book_ticker_stream, "trades": settings.enable_agg_trade_stream}
    names = stream_path(settings.stream_symbol, **on)
    url = f"{settings.ws_base_url.rstrip('/')}/stream?streams={names}"
    land = FrameFiles(folder, rows=settings.batch_rows, flush_s=settings.flush_ms / 1000)
    connect = lambda: WebSocket(url, settings.ws_read_idle_timeout_secs)
    return collect(connect, land, most_wait_s=settings.ws_reconnect_backoff_max_secs, jitter_bps=settings.ws_reconnect_jitter_bps, **options)
