"""Judging the detections of many images and classes at once: numpy over batches of rows, group after group.

A detection takes the free object of highest overlap, in the order of score and list position. All thresholds are
settled together, as bits: a pair is taken in those cells in which it overlaps enough, its object is free and its
detection still looks for one. Pairs whose sides are in no other pair are settled in one step. Of the others every group
has its pairs in the order of their turns, and one step settles the next pair of every group of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are compared in one go.
_ROOM = 1_000_000

Cells = list[tuple[float, float, float]]  # threshold, least and greatest area


def _numbers(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The group of each row, from 0 on; rows of one group stand together, and nulls are alike."""
    new = np.zeros(len(batch), bool)
    for c in keys:
        new[1:] |= np.diff(pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a group ends."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, i: [batch.column(c)[i].as_py() for c in keys]
    for batch in batches:
        if not batch.num_rows:
            continue
        group = _numbers(batch, keys)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and key(held[-1], -1) != key(batch, 0):
            yield pa.concat_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _doubles(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], crowd: np.ndarray) -> np.ndarray:
    """geometry.crowd_iou() of boxes, one by one."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    inter = np.maximum(0.0, np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx)) * np.maximum(0.0, np.minimum(ay + ah, by + bh) - np.maximum(ay, by))
    union = np.where(crowd, aw * ah, aw * ah + bw * bh - inter)
    return np.divide(inter, union, out=np.zeros(len(inter)), where=union > 0)


def _near(det: list[np.ndarray], first: np.ndarray, n: np.ndarray, obj: list[np.ndarray], crowd: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(detection, object, overlap) of the pairs from `least` on; a detection meets the n objects from `first` on."""
    found, ends, lo = [], np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _ROOM, "right")))
        d = np.repeat(np.arange(lo, hi), n[lo:hi])
        o = np.arange(len(d)) - np.repeat(ends[lo:hi] - n[lo:hi] - (ends[lo - 1] if lo else 0), n[lo:hi]) + first[d]
        v = _overlaps([x[d] for x in det], [x[o] for x in obj], crowd[o])
        keep = v >= least
        found.append((d[keep], o[keep], v[keep]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _settle(turn: np.ndarray, segment: np.ndarray, d: np.ndarray, o: np.ndarray, reach: np.ndarray, crowd: np.ndarray, ignored: np.ndarray, hit: np.ndarray, hit_ig: np.ndarray) -> None:
    """Takes pairs by their turns within each segment, for the cells in reach."""
    at = turn[np.argsort(segment[turn], kind="stable")]
    new = np.flatnonzero(np.r_[True, np.diff(segment[at]) != 0])
    step = np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)]))
    by_step = np.argsort(step, kind="stable")
    at, ends = at[by_step], np.cumsum(np.bincount(step))
    d, o, reach, crowd, ignored = d[at], o[at], reach[at], crowd[at], ignored[at]
    mine, theirs = np.zeros(len(hit), np.int64), np.zeros(int(o.max()) + 1, np.int64)
    for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True):
        i, j = d[lo:hi], o[lo:hi]
        got = reach[lo:hi] & ~mine[i] & ~theirs[j]
        mine[i] |= got
        theirs[j] |= np.where(crowd[lo:hi], 0, got)
        hit_ig[i] |= np.where(ignored[lo:hi], got, 0)
    hit |= mine


def _bits(cells: Cells, when) -> np.ndarray:
    """The cells in which a condition holds."""
    return sum(when(*c).astype(np.int64) << k for k, c in enumerate(cells))


def _judge(batch: pa.RecordBatch, keys: list[str], cells: Cells, ranges: list[tuple[float, float]], most: int) -> pa.RecordBatch:
    every = _numbers(batch, keys)
    groups = int(every[-1]) + 1
    is_object = batch.column("is_object").to_numpy(zero_copy_only=False)
    g, p = (batch.take(pa.array(np.flatnonzero(x))) for x in (is_object, ~is_object))
    holder, group = every[is_object], every[~is_object]
    n_g, n_p = np.bincount(holder, minlength=groups), np.bincount(group, minlength=groups)
    start = np.searchsorted(every, np.arange(groups))
    # a group with a null among its keys has no pairs
    lacking = np.any([batch.column(c).is_null().to_numpy(zero_copy_only=False)[start] for c in keys], axis=0)
    gx = _doubles(g, "x", "y", "w", "h")
    area = _doubles(g, "area")[0]
    crowd, plain = (pc.fill_null(pc.equal(g.column("iscrowd"), k), False).to_numpy(zero_copy_only=False) for k in (1, 0))
    coded = pc.dictionary_encode(p.column("mode"), null_encoding="encode")
    mode = coded.indices.to_numpy(zero_copy_only=False)
    score, place = _doubles(p, "score")[0], p.column("det_ord").to_numpy(zero_copy_only=False)
    order = np.lexsort((place, -score, mode, group))
    group, mode = group[order], mode[order]
    new = np.r_[np.ones(min(1, len(order)), bool), (np.diff(group) != 0) | (np.diff(mode) != 0)]
    segment = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    rank = np.arange(len(order)) - begin[segment] + 1
    first = rank <= most
    of_group, of_mode = group[begin], mode[begin]
    order, group, segment, rank = order[first], group[first], segment[first], rank[first]
    dx = [x[order] for x in _doubles(p, "x", "y", "w", "h")]
    d, o, v = _near(dx, (np.cumsum(n_g) - n_g)[group], np.where(lacking, 0, n_g)[group], gx, crowd, min(t for t, _, _ in cells))
    # an object is free for every mode by itself
    _, own = np.unique(segment[d] * max(1, len(g)) + o, return_inverse=True)
    reach = _bits(cells, lambda t, lo, hi: v >= min(t, 1 - 1e-10)) if len(d) else np.zeros(0, np.int64)
    outside = lambda lo, hi: (crowd | (area < lo) | (area > hi))[o]
    hit, hit_ig = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    alone = (np.bincount(d, minlength=1)[d] == 1) & (np.bincount(own, minlength=1)[own] == 1)
    if alone.any():
        hit[d[alone]] = reach[alone]
        hit_ig[d[alone]] = (reach & _bits(cells, lambda t, lo, hi: outside(lo, hi)))[alone]
    rest = np.flatnonzero(~alone)
    if len(rest):
        ann = g.column("ann_id").to_numpy(zero_copy_only=False)[o]
        for lo, hi in ranges:
            ignored = outside(lo, hi)
            turn = rest[np.lexsort((-ann[rest], -v[rest], ignored[rest], d[rest]))]
            own_cells = sum(1 << k for k, c in enumerate(cells) if c[1:] == (lo, hi))
            _settle(turn, segment[d], d, own, reach & own_cells, crowd[o], ignored, hit, hit_ig)
    size = dx[2] * dx[3]
    beyond = _bits(cells, lambda t, lo, hi: (size < lo) | (size > hi))
    values = {"score": p.column("score").take(pa.array(order)), "det_ord": p.column("det_ord").take(pa.array(order)), "rank": pa.array(rank, pa.int32()), "tp": pa.array(hit & ~hit_ig), "ignored": pa.array(hit_ig | (beyond & ~hit))}
    # groups without detections follow, with no mode; objects are told beside the first mode
    bare = np.flatnonzero(n_p == 0)
    row = np.r_[of_group, bare].astype(np.int64)
    told = np.r_[np.r_[np.ones(min(1, len(begin)), bool), np.diff(of_group) != 0], np.ones(len(bare), bool)]
    npig = [np.bincount(holder[plain & (area >= lo) & (area <= hi)], minlength=groups)[row] * told for lo, hi in ranges]
    modes = coded.dictionary.take(pa.array(np.r_[of_mode, np.zeros(len(bare), np.int64)].astype(np.int64), mask=np.r_[np.zeros(len(begin), bool), np.ones(len(bare), bool)]))
    ends = np.r_[0, np.cumsum(np.r_[np.bincount(segment, minlength=len(begin)), np.zeros(len(bare), np.int64)])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(values.values()), list(values)))
    return pa.record_batch([*[batch.column(c).take(pa.array(start[row])) for c in keys], modes, *[pa.array(x.astype(np.int64)) for x in npig], lists], [*keys, "mode", *[f"npig_{i}" for i in range(len(ranges))], "d"])


def judge(batches: Iterator[pa.RecordBatch], keys: list[str], thresholds: list[float], ranges: list[tuple[float, float]], most: int) -> Iterator[pa.RecordBatch]:
    """(keys, mode, npig of each area range, d) of objects and detections in the order of their keys: see coco.matched()."""
    cells = [(t, *r) for t in thresholds for r in ranges]
    for batch in whole_groups(batches, keys):
        yield _judge(batch, keys, cells, ranges, most)
