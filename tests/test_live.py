"""The live feed against a small server of our own."""

import base64
import hashlib
import json
import os
import socket
import struct
import threading

import pytest

from lobspark.config import Settings
from lobspark.sources import live
from lobspark.streaming import jobs


def frame(data, kind=live.TEXT, last=True):
    size = struct.pack("!B", len(data)) if len(data) < 126 else struct.pack("!BH", 126, len(data)) if len(data) < 65536 else struct.pack("!BQ", 127, len(data))
    return struct.pack("!B", (128 if last else 0) | kind) + size + data


class Server(threading.Thread):
    """Serves one script of bytes a connection; None leaves the client in silence."""

    def __init__(self, scripts, good=True):
        super().__init__(daemon=True)
        self.scripts, self.good, self.got = scripts, good, []
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.url = f"ws://127.0.0.1:{self.socket.getsockname()[1]}/stream?streams=x@depth"
        self.start()

    def run(self):
        for script in self.scripts:
            client, _ = self.socket.accept()
            asked = b""
            while b"\r\n\r\n" not in asked:
                asked += client.recv(4096)
            key = next(x.split(b": ")[1] for x in asked.split(b"\r\n") if x.startswith(b"Sec-WebSocket-Key"))
            accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest()) if self.good else b"wrong"
            client.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
            if script is None:
                client.settimeout(5)
                try:
                    self.got.append(client.recv(4096))
                except OSError:
                    pass
            else:
                client.sendall(script)
                if live.PING in [b & 15 for b in script[:1]]:
                    self.got.append(client.recv(4096))
            client.close()


def test_collect_reconnects(spark, tmp_path):
    trade = json.dumps({"stream": "x@aggTrade", "data": {"e": "aggTrade", "E": 7, "T": 6, "s": "X", "a": 3, "p": "1.5", "q": "2", "f": 1, "l": 1, "m": True, "pad": "y" * 300}}).encode()
    half = len(trade) // 2
    server = Server([
        frame(b"are you there", live.PING) + frame(trade) + frame(b"\x00", live.BINARY) + frame(b"", live.CLOSE),
        None,  # silence
        frame(trade[:half], last=False) + frame(b"", live.PING) + frame(trade[half:], live.CONTINUED) + frame(b"\xff\xfe") + frame(b"x" * 70_000) + b"\x81",  # ends inside a frame
        frame(b"{}"),
    ])
    waits, home = [], str(tmp_path / "frames")
    told = live.collect(lambda: live.WebSocket(server.url, 0.3), live.FrameFiles(home, rows=2), sleep=waits.append, jitter_bps=0, stop=lambda: len(waits) >= 6)
    assert told["frames"] == 4 and told["not_utf8"] == 1 and told["ws_connected"] == 4 and told["ws_idle_timeouts"] >= 1 and told["ws_read_errors"] >= 1
    assert told["ws_closed"] >= 1 and told["ws_reconnects_scheduled"] == len(waits) and waits[:2] == [1.0, 1.0]
    pong = server.got[0]
    assert pong[0] & 15 == live.PONG and bytes(b ^ pong[2 + i % 4] for i, b in enumerate(pong[6:])) == b"are you there"
    files = sorted(os.listdir(home))
    assert not [f for f in files if f.endswith(".tmp")]
    rows = [json.loads(x) for f in files for x in open(f"{home}/{f}")]
    assert [r[0] for r in rows] == ["0", "1", "2", "3"]
    assert live.FrameFiles(home).next == 4  # a new process goes on
    q = jobs.layers(jobs.read_frames(spark, home))["trade"].writeStream.format("memory").queryName("live_trades").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("live_trades").count() == 2


def test_waits_double_while_nothing_answers(tmp_path):
    waits = []

    def refused():
        raise ConnectionRefusedError

    told = live.collect(refused, live.FrameFiles(str(tmp_path)), sleep=waits.append, most_wait_s=5, jitter_bps=0, stop=lambda: len(waits) >= 5)
    assert waits == [1.0, 2.0, 4.0, 5.0, 5.0] and told["ws_connect_failures"] == 5 == told["ws_connect_attempts"]


def test_a_server_that_does_not_shake_hands():
    with pytest.raises(ConnectionError):
        live.WebSocket(Server([b""], good=False).url, 1.0)


def test_run_asks_for_the_streams_of_the_profile(tmp_path):
    server = Server([frame(b"{}")])
    waits = []
    base = server.url.split("/stream")[0]
    settings = Settings.from_env({"APP_WS_BASE_URL": base, "APP_FLUSH_MS": "100", "APP_WS_READ_IDLE_TIMEOUT_SECS": "2"})
    told = live.run(settings, str(tmp_path), sleep=waits.append, stop=lambda: len(waits) >= 1)
    assert told["frames"] == 1 and len(os.listdir(tmp_path)) == 1
    with pytest.raises(ValueError, match="APP_WS_BASE_URL"):
        live.run(Settings(), str(tmp_path))
    with pytest.raises(ValueError):
        Settings(ws_read_idle_timeout_secs=0)
