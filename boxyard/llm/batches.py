"""Arrow batches as plain bytes: helpers for functions given to mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_blocks(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches with a string or binary column `text` into blocks of about `most` bytes.

    Yields (rows, bytes, bounds): row i has bytes[bounds[i]:bounds[i + 1]]; a null text has none. A single longer text
    is a block of its own.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            kind = np.int64
        else:
            kind = np.int32
        n = len(col)
        if not n:
            continue
        bufs = col.buffers()
        bounds = np.frombuffer(bufs[1], kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + lengths[i] - 1, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of substrings of a sequence of numbers, by prefix sums modulo 2**64 (base odd, hence invertible)."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up))
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums; values are scrambled first, so small ones do."""
        n = len(values)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._up[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], wherever it stands."""
        return mix((prefix[end] - prefix[start]) * self._down[start])

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k values."""
        n = len(prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = prefix[k:] - prefix[:n]
        h *= self._down[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h


_BYTES = None


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each byte."""
    global _BYTES
    if _BYTES is None:
        _BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    return _BYTES[data]


_PLACE = np.uint64((1 << 24) - 1)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of x[i:i+w] for every i, the first of equals; only the top 40 bits count.

    The position rides in the low bits; windows of 2, 4, 8, ... are combined up to w. x has less than 2**24 entries.
    """
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    m = (x & ~_PLACE) | np.arange(len(x), dtype=np.uint64)
    have = 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[:n], m[w - have : w - have + n])
    return (m & _PLACE).astype(np.int64)


SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the words of a block of texts, and the number of words of each text."""
    inside = ~SPACES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]  # a text's end ends its last word
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, bounds))
