"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Leftmost-smaller substrings are named by comparing neighbours, and the text of their names is sorted in the same way until
all names differ. With a small alphabet the work of a bucket is done in whole slices: everything that the suffixes of
one slice induce is filed at once, in a stable order, so the number of numpy calls depends on the alphabet and on the longest
run of one symbol. Names are a large alphabet of small buckets, where suffixes are induced one by one; both are linear.
"""

from __future__ import annotations

import array

import numpy as np

from boxyard.llm.batches import ranges

#: Symbols up to which buckets are filed in slices.
FEW_SYMBOLS = 3000


def _smaller_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. t ends with its only least symbol."""
    n = len(t)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    nxt = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # last position of the run of equal symbols
    nxt[-1] = n - 2 if n > 1 else 0
    s = np.zeros(n, bool)
    s[:-1] = t[nxt[:-1]] < t[np.minimum(nxt[:-1] + 1, n - 1)]
    s[-1] = True
    return s


def _file(order_key: np.ndarray, ptr: np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stable places for suffixes with these first symbols; moves the buckets' pointers."""
    order = np.argsort(order_key, kind="stable")
    key = order_key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(key)))
    rank = np.arange(len(key)) - np.repeat(at, count)
    place = ptr[key] - 1 - rank if down else ptr[key] + rank
    ptr[key[at]] += -count if down else count
    return order, place


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix array induced from leftmost-smaller suffixes in their order (or, before they are sorted, in any)."""
    n = len(t)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    n_larger = np.bincount(t[~smaller], minlength=len(sizes))
    n_lms = np.bincount(t[lms], minlength=len(sizes))
    sa = np.zeros(n, np.int32)
    key = t[lms]
    order, place = _file(key, ends - n_lms, False)
    sa[place] = lms[order]
    used = np.flatnonzero(sizes)
    ptr = heads.copy()

    def larger(chunk: np.ndarray) -> None:
        j = chunk[chunk > 0] - 1
        j = j[~smaller[j]]
        if len(j):
            order, place = _file(t[j], ptr, False)
            sa[place] = j[order]

    for c in used:
        lo = heads[c]
        while lo < ptr[c]:
            hi = ptr[c]
            larger(sa[lo:hi])
            lo = hi
        if n_lms[c]:
            larger(sa[ends[c] - n_lms[c] : ends[c]])
    ptr = ends.copy()

    def less(chunk: np.ndarray) -> None:
        j = chunk[chunk > 0] - 1
        j = j[smaller[j]]
        if len(j):
            order, place = _file(t[j], ptr, True)
            sa[place] = j[order]

    for c in used[::-1]:
        hi = ends[c]
        while hi > ptr[c]:
            lo = ptr[c]
            less(sa[lo:hi][::-1])
            hi = lo
        if n_larger[c]:
            less(sa[heads[c] : heads[c] + n_larger[c]][::-1])
    sa[0] = n - 1
    return sa


def _ints(x: np.ndarray) -> array.array:
    return array.array("i", x.astype(np.int32).tobytes())


def _induce_each(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for alphabets of many symbols: one suffix after the other."""
    t, ends = t.astype(np.int64), np.cumsum(sizes)
    # arrays and not lists: a third of the memory, which matters where several tasks share a cache
    ptr = _ints(ends)
    sa = array.array("i", bytes(4 * len(t)))  # 0 induces nothing
    for j, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist(), strict=True):
        p = ptr[c] = ptr[c] - 1
        sa[p] = j
    # by suffix, the bucket of the one before it, or -1 if that is not induced in this direction
    before = np.full(len(t), -1, np.int64)
    before[1:] = np.where(smaller[:-1], -1, t[:-1])
    bucket, ptr = _ints(before), _ints(ends - sizes)
    for j in sa:  # what is written ahead of here is read in its turn
        c = bucket[j]
        if c >= 0:
            p = ptr[c]
            sa[p] = j - 1
            ptr[c] = p + 1
    before[1:] = np.where(smaller[:-1], t[:-1], -1)
    bucket, ptr = _ints(before), _ints(ends)
    for j in reversed(sa):
        c = bucket[j]
        if c >= 0:
            p = ptr[c] = ptr[c] - 1
            sa[p] = j - 1
    sa[0] = len(t) - 1
    return np.frombuffer(sa, np.int32)


def _same_as_before(t: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the substrings t[order[i] : order[i] + length[i]] equals the one before it."""
    same = np.zeros(len(order), bool)
    i = np.flatnonzero(length[1:] == length[:-1]) + 1
    if len(i):
        n = length[i]
        equal = t[ranges(order[i], n)] == t[ranges(order[i - 1], n)]
        same[i] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


def _sorted(t: np.ndarray, n_symbols: int) -> np.ndarray:
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    induce = _induce if n_symbols <= FEW_SYMBOLS else _induce_each
    smaller = _smaller_types(t)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    sizes = np.bincount(t, minlength=n_symbols)
    sa = induce(t, smaller, lms, sizes)
    order = sa[is_lms[sa]].astype(np.int64)
    # leftmost-smaller substrings, each up to the next one's first symbol, get names in their order
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    differs = ~_same_as_before(t, order, length[order])
    differs[0] = False
    name_of = np.zeros(n, np.int64)
    name_of[order] = np.cumsum(differs)
    names = name_of[lms]
    n_names = int(differs.sum()) + 1
    if n_names < len(lms):
        order = lms[_sorted(names.astype(np.uint16 if n_names < 1 << 16 else np.int64), n_names)]
    return induce(t, smaller, order.astype(np.int32), sizes)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start of each suffix of a byte array, in the suffixes' order."""
    used, t = np.unique(data, return_inverse=True)
    if not len(data):
        return np.zeros(0, np.int32)
    t = np.append(t.astype(np.uint16) + 1, 0).astype(np.uint16)
    return _sorted(t, len(used) + 1)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): by text position, the common prefix with the next smaller suffix and where that is (-1: none).

    Only positions whose left neighbours differ are compared, eight bytes at a time; at the others the prefix is the
    previous position's less one.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    p = np.arange(n)
    has = phi >= 0
    fresh = ~has
    inner = has & (p > 0) & (phi > 0)
    fresh |= has & ~inner
    fresh[inner] = data[p[inner] - 1] != data[phi[inner] - 1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    a = np.flatnonzero(fresh & has)
    b = phi[a]
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    at = 0
    while len(live):
        x = eight[a[live] + at] ^ eight[b[live] + at]
        equal = x == 0
        low = x & (~x + np.uint64(1))
        length[live] = at + np.where(equal, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        at += 8
        live = live[equal & (np.maximum(a[live], b[live]) + at < n)]
    reach = np.zeros(n, np.int64)
    reach[a] = np.minimum(length, n - np.maximum(a, b)) + a
    reach[fresh & ~has] = p[fresh & ~has]
    return np.maximum.accumulate(reach) - p, phi


def repeated(data: np.ndarray, window: int) -> np.ndarray:
    """Mask of the positions whose next `window` bytes also start elsewhere in data."""
    sa = suffix_array(data)
    plcp, phi = common_prefixes(data, sa)
    flag = plcp >= window
    flag[phi[flag]] = True
    return flag
