"""Small numbers of many samples as bytes: two bits for each, and two bytes for each that is 3 or more."""

from __future__ import annotations

import numpy as np


def packed(rows: np.ndarray) -> list[bytes]:
    """Rows of 16-bit numbers, each row as bytes: how many numbers, their two bits (3: it follows behind), and those from 3 on."""
    m, n = rows.shape
    two = np.zeros((m, -(-n // 4) * 4), np.uint8)
    two[:, :n] = np.minimum(rows, 3)
    heads = two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6
    large = rows >= 3
    values, ends = rows[large].astype("<u2"), np.r_[0, np.cumsum(large.sum(axis=1))]
    size = np.array([n], "<u2").tobytes()
    return [size + heads[i].tobytes() + values[ends[i] : ends[i + 1]].tobytes() for i in range(m)]


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The numbers of packed() rows, which have the same number of them."""
    if not rows:
        return np.zeros((0, 1), np.uint16)
    n = int(np.frombuffer(rows[0], "<u2", 1)[0])
    raw = np.frombuffer(b"".join(rows), np.uint8)
    sizes = np.array([len(x) for x in rows])
    begin = np.cumsum(sizes) - sizes
    at = begin[:, None] + np.arange(2 - (-n // 4))
    behind = np.ones(len(raw), bool)
    behind[at] = False
    two = raw[at[:, 2:]][:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    out = two.reshape(len(rows), -1)[:, :n].astype(np.uint16)
    out[out == 3] = raw[behind].view("<u2")
    return out
