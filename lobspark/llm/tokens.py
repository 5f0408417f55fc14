"""Vectorised word hashing for Arrow batches: texts to 64-bit token hashes, no per-word Python.

Words are runs of bytes other than the six separators; A-Z count as a-z. A word's hash is
a polynomial over random byte values modulo 2**64, mixed with its length; two of n words
share one with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

from lobspark.llm.common import SPACES

_STEP = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_draw = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
#: Token hashes that no word has but by a collision.
BEGIN, END = np.uint64(0x5D588B656C078965), np.uint64(0x27BB2EE687B0B0FD)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    found = _powers.get(kind)
    if found is None or len(found) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        found = np.full(max(n, 2 * _STEP), base, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= 4 * _STEP:
            _powers[kind] = found
    return found[:n]


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _STEP, "right")))
        part = data[a : ends[j - 1]]
        n = len(part)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _power("up", n), out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _power("down", n)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def token_hashes(text: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words up to each text: n + 1 entries). Nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    n = len(text)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    text = text.fill_null("").cast(pa.large_string())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    low, high = int(at[0]), int(at[-1])
    if data is None or low == high:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[low:high]
    at = at - low
    word = ~_SPACE[data]
    fresh = np.empty(len(word), bool)
    fresh[0] = True
    np.logical_not(word[:-1], out=fresh[1:])
    fresh[at[:-1][at[:-1] < len(word)]] = True
    starts = np.flatnonzero(word & fresh)
    last = np.empty(len(word), bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    inner = at[1:][at[1:] > 0] - 1
    last[inner] = True
    ends = np.flatnonzero(word & last) + 1
    return _hash(data, starts, ends), np.searchsorted(starts, at)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key, rising with the key, so a sorted array falls into slices."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as one byte each, and those over 254 again in full."""
    big = counts > 254
    return np.where(big, 255, counts).astype(np.uint8).tobytes(), counts[big].astype(np.int64).tobytes()


def unpack(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    if large:
        out[out == 255] = np.frombuffer(large, np.int64)
    return out


def release() -> None:
    """Give freed memory back, so that idle workers do not hold what their last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(work):
    """work on one Arrow table or two, then release()."""

    def one(table):
        try:
            return work(table)
        finally:
            release()

    def two(left, right):
        try:
            return work(left, right)
        finally:
            release()

    return one if work.__code__.co_argcount == 1 else two
