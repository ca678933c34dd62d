"""Vectorised text primitives shared by the operators: blocks of bounded bytes, word spans, 64-bit word hashes.

All functions work on the UTF-8 bytes of an Arrow string column, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a block holds, unless one text alone is longer.
BLOCK_BYTES = 2 << 20
#: Bytes hashed at a time; a longer word is hashed by BLAKE2b.
_STRIDE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([i < 0x80 and not chr(i).isalnum() for i in range(256)])
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_PRIME = 0x9E3779B97F4A7C15 | 5
_RAW = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _RAW.copy()
_FOLDED[65:91] = _RAW[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done, step = 1, 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done, step = done + take, step * step % 2**64
    return out


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables["up"] = _powers(_PRIME, _STRIDE + 1)
        _tables["down"] = _powers(pow(_PRIME, -1, 2**64), _STRIDE + 1)
    return _tables[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices of at most ``limit`` bytes of text (or one row), each with its bytes and its rows' offsets in them.

    A null text has no bytes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
            first = last


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes outside ``breaks``, and for each row the number of runs before it."""
    inside = ~breaks[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut] = inside[cut]
    stops[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``fold`` takes A-Z as a-z.  Spans are in order and don't overlap."""
    table, up, down = (_FOLDED if fold else _RAW), _table("up"), _table("down")
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + _STRIDE, "right"))
        if j <= i:
            word = data[a : int(ends[i])].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest(), "little")
            i += 1
            continue
        b = int(ends[j - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def windows(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` consecutive words of a row, and the index of its first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    row_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(size, n + size) <= row_end)
    return mix(out[at]), at


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's stretch of ``values``."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (data & 0xC0) != 0x80
