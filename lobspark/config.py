"""Instruments and settings: frozen, validated when read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

#: The six instruments (exchange symbol, market, contract, stream symbol).
INSTRUMENTS = {
    ("spot", "BTCUSD"): "linear",
    ("spot", "ETHUSD"): "linear",
    ("coinm", "BTCUSD_PERP"): "inverse",
    ("coinm", "ETHUSD_PERP"): "inverse",
    ("usdm", "BTCUSDT"): "linear",
    ("usdm", "ETHUSDT"): "linear",
}
#: Other spellings of the markets and cancel policies.
MARKET_NAMES = {
    "spot": ["spot", "spot-market", "spot_market"],
    "coinm": ["coinm", "coin-m", "coin_m", "coin-m-futures"],
    "usdm": ["usdm", "usd-m", "usd_m", "usd-m-futures"],
}
CANCEL_NAMES = {"lifo": ["lifo"], "prorata": ["prorata", "pro_rata", "pro-rata"]}


def _one_of(value: str, names: Mapping[str, list[str]], what: str) -> str:
    found = [k for k, v in names.items() if value.strip().lower() in v]
    if not found:
        raise ValueError(f"{what}: {value!r} is none of {', '.join(names)}")
    return found[0]


def _read(kind: type, value: str, key: str):
    if kind is not bool:
        return kind(value)
    if value.lower() not in ("true", "false"):
        raise ValueError(f"{key}: {value!r} is neither true nor false")
    return value.lower() == "true"


@dataclass(frozen=True)
class Settings:
    """What a replay or a stream needs to know; times in milliseconds."""

    exchange: str = "binance"
    market: str = "coinm"
    symbol: str = "BTCUSD_PERP"
    contract: str = ""
    contract_size: float = 100.0
    cancel_heuristic: str = "lifo"
    depth_limit: int = 1000
    reorder_hold_ms: int = 20
    trade_alignment_max_lag_ms: int = 250
    execution_match_lookahead_ms: int = 40
    reorder_resync_max_buffer_lag_ms: int = 3000
    reorder_capacity: int = 50_000
    snapshot_dump_interval_secs: int = 3600
    chunk_rows: int = 10_000
    batch_rows: int = 500
    flush_ms: int = 500
    retention_days: int = 30
    channel_capacity: int = 20_000
    enable_depth_stream: bool = True
    enable_book_ticker_stream: bool = True
    enable_agg_trade_stream: bool = True
    ws_base_url: str = ""
    ws_read_idle_timeout_secs: int = 45
    ws_reconnect_backoff_max_secs: int = 30
    ws_reconnect_jitter_bps: int = 1000
    ntp_slew_alpha: float = 0.25
    ntp_slew_max_step_ms: int = 25
    data_root: str = "data"
    raw_spool_dir: str = ""
    metrics_dir: str = ""
    upload_bucket: str = ""
    upload_prefix: str = ""

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("market", _one_of(self.market, MARKET_NAMES, "market"))
        put("cancel_heuristic", _one_of(self.cancel_heuristic, CANCEL_NAMES, "cancel heuristic"))
        put("symbol", self.symbol.strip().upper())
        put("exchange", self.exchange.strip().lower())
        if not self.exchange or not self.symbol:
            raise ValueError("exchange and symbol must not be empty")
        known = INSTRUMENTS.get((self.market, self.symbol), "linear")
        put("contract", (self.contract or known).strip().lower())
        if self.contract not in ("linear", "inverse"):
            raise ValueError(f"contract: {self.contract!r} is neither linear nor inverse")
        if self.contract_size <= 0:
            raise ValueError("contract_size must be positive")
        for name in ("depth_limit", "reorder_capacity", "chunk_rows", "batch_rows", "flush_ms", "channel_capacity", "ws_read_idle_timeout_secs"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("reorder_hold_ms", "trade_alignment_max_lag_ms", "execution_match_lookahead_ms", "snapshot_dump_interval_secs"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not (self.enable_depth_stream or self.enable_book_ticker_stream or self.enable_agg_trade_stream):
            raise ValueError("at least one stream must be enabled")
        if not 0 <= self.ws_reconnect_jitter_bps <= 5000:
            raise ValueError("ws_reconnect_jitter_bps must lie in 0 to 5000")
        if not 0 < self.ntp_slew_alpha <= 1 or self.ntp_slew_max_step_ms <= 0:
            raise ValueError("ntp_slew_alpha must lie in (0, 1] and ntp_slew_max_step_ms be positive")
        put("raw_spool_dir", self.raw_spool_dir or f"{self.data_root}/raw")
        put("metrics_dir", self.metrics_dir or f"{self.data_root}/metrics")
        put("upload_prefix", (self.upload_prefix or f"lobspark/{self.exchange}/{self.market}").strip("/"))

    @property
    def overlap_allowed(self) -> bool:
        """Spot streams may repeat ids; futures name the update they follow."""
        return self.market == "spot"

    @property
    def stream_symbol(self) -> str:
        return self.symbol.lower()

    @property
    def upload_target(self) -> str:
        """Where finished days go: s3a unless the bucket is a path or names a scheme; empty without a bucket."""
        if not self.upload_bucket:
            return ""
        plain = "://" not in self.upload_bucket and not self.upload_bucket.startswith("/")
        return f"{'s3a://' * plain}{self.upload_bucket.rstrip('/')}/{self.upload_prefix}"

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "APP_") -> Settings:
        """Settings from a profile's variables (``APP_SYMBOL=...``); unknown ones are left alone."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        names = {
            "contract_type": "contract", "raw_parquet_chunk_rows": "chunk_rows", "metrics_retention_days": "retention_days",
            "reorder_resync_max_lag_ms": "reorder_resync_max_buffer_lag_ms", "s3_bucket": "upload_bucket", "s3_prefix": "upload_prefix",
            "clickhouse_batch_size": "batch_rows", "clickhouse_flush_ms": "flush_ms",
        }
        found = {}
        for key, value in env.items():
            name = key.removeprefix(prefix).lower()
            name = names.get(name, name)
            if key.startswith(prefix) and name in kinds and value.strip():
                found[name] = _read(kinds[name], value.strip(), key)
        return cls(**found)

    @classmethod
    def from_file(cls, path: str) -> Settings:
        """A profile file of KEY=VALUE lines; # begins a comment."""
        with open(path) as f:
            lines = [x.split("#", 1)[0].strip() for x in f]
        return cls.from_env({k.strip(): v.strip().strip("'\"") for k, _, v in (x.partition("=") for x in lines if "=" in x)})
