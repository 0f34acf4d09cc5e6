"""Precision and recall curves of classes of any size, and of many weighted samples of their images at once.

Detections are sorted once, by class and falling score, and dealt by ranges. Every range gives its sums, the sums of the
ranges before it are its offsets, and inside a range numpy adds up. The best precision from a position on is the best of
its range or of a later one: a range tells its own best, and for each of the 101 recall points that it reaches the best
from there to its end, so what ranges tell is small and meets at the end.

A sample gives every image a weight, how often it was drawn. A detection counts as often as its image, and its copies
stand together at its place in the order. So all samples share one order, and only their sums differ.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxyard.functions.counts import unpacked
from boxyard.operators.ranges import in_ranges
from boxyard.sources.tables import keep

CLASS = ["dataset", "mode", "category_id"]
_ULP = 2.220446049250313e-16
_POINTS = np.arange(101) * 0.01

#: Numbers in an array of rows x samples.
_ROOM = 2_000_000


def bit_of(mask: str, k: int) -> Column:
    return F.call_function("shiftright", F.col(mask), F.lit(k)).bitwiseAND(F.lit(1).cast("long"))


def _bits(t: pa.Table, name: str, cells: np.ndarray) -> np.ndarray:
    return (t.column(name).to_numpy()[:, None] >> cells[None, :]) & 1


def _weights(t: pa.Table) -> np.ndarray:
    """How often each row counts in each sample: packed() numbers."""
    if "weights" not in t.column_names:
        return np.ones((len(t), 1), np.uint16)
    return unpacked(t.column("weights").to_pylist())


def _own_key(t: pa.Table, n: int, names: list[str]) -> dict[str, pa.Array]:
    return {c: pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type) for c in names}


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.array(x.tolist(), pa.list_(pa.float64()))


def _runs(t: pa.RecordBatch) -> np.ndarray:
    """Where runs of rows of one class and range begin."""
    new = np.ones(len(t), bool)
    new[1:] = False
    for c in (*CLASS, "_range"):
        x = t.column(c)
        new[1:] |= pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(t) - 1)), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _partial_sums(batches: Iterator[pa.RecordBatch], cells: int, ranks: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Of each run of rows of one class and range: hits and counted detections of every cell, and the hits among the first of an image."""
    keys, every = [*CLASS, "_range"], np.arange(cells)
    for t in batches:
        at = _runs(t)
        hit, counted = _bits(t, "tp", every), 1 - _bits(t, "ignored", every)
        rank = t.column("rank").to_numpy() if ranks else None
        values = [hit, counted, *[hit * (rank <= r)[:, None] for r in ranks]]
        first = pa.array(np.repeat(at, cells))
        sums = [pa.array(np.add.reduceat(v, at, axis=0).ravel().astype(np.int64)) for v in values]
        yield pa.record_batch([*[t.column(c).take(first) for c in keys], pa.array(np.tile(every, len(at)), pa.int32()), *sums], [*keys, "cell", "tps", "n", *[f"first_{r}" for r in ranks]])


def _weighted_sums(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The same of hits and counted detections, for every sample."""
    keys, every = [*CLASS, "_range"], np.arange(cells)
    for t in batches:
        if not len(t):
            continue
        at, w = _runs(t), _weights(t).astype(float)
        hit, counted = _bits(t, "tp", every).astype(float), 1.0 - _bits(t, "ignored", every)
        first = pa.array(np.repeat(at, cells))
        sums = [_doubles(np.concatenate([v[lo:hi].T @ w[lo:hi] for lo, hi in itertools.pairwise([*at.tolist(), len(t)])])) for v in (hit, counted)]
        yield pa.record_batch([*[t.column(c).take(first) for c in keys], pa.array(np.tile(every, len(at)), pa.int32()), *sums], [*keys, "cell", "tps", "n"])


def _own(ranked: DataFrame) -> str:
    return ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in CLASS)


def range_sums(ranked: DataFrame, cells: int, ranks: tuple[int, ...] = ()) -> DataFrame:
    """(CLASS, _range, cell, tps, n, first_<rank>...) of sorted_detections(): sums of each range, without dealing rows anew."""
    names = ["tps", "n", *[f"first_{r}" for r in ranks]]
    d = ranked.select(*CLASS, "_range", "tp", "ignored", *(["rank"] if ranks else []))
    part = d.mapInArrow(lambda b: _partial_sums(b, cells, ranks), f"{_own(ranked)}, _range long, cell int, " + ", ".join(f"{c} long" for c in names))
    return keep(part.groupBy(*CLASS, "_range", "cell").agg(*[F.sum(c).alias(c) for c in names]), "sums")


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, as rows."""
    return pc.list_flatten(lists).to_numpy().reshape(len(lists), -1)


def _thresholds(objects: np.ndarray) -> np.ndarray:
    """For each sample the hits from which each recall point is reached (at least one), a row for each point."""
    least = np.ceil(_POINTS[:, None] * objects)
    # as the quotient of two doubles tells it
    least = np.where((least - 1) / objects >= _POINTS[:, None], least - 1, least)
    return np.maximum(np.where(least / objects >= _POINTS[:, None], least, least + 1), 1)


def _cell_runs(t: pa.Table, order: str) -> tuple[pa.Table, list[tuple[int, int]]]:
    """Rows by cell and range, and where each cell begins and ends."""
    t = t.sort_by([("cell", "ascending"), ("_range", order)])
    cell = t.column("cell").to_numpy()
    at = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
    return t, list(itertools.pairwise(at))


def _before(t: pa.Table) -> pa.Table:
    """Of a class: for each cell the sums of all ranges before each; the sums of a range may be in parts."""
    t, _ = _cell_runs(t, "ascending")
    cell, part = t.column("cell").to_numpy(), t.column("_range").to_numpy()
    own = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(part) != 0)])
    tps, n = (np.add.reduceat(_matrix(t.column(c)), own, axis=0) for c in ("tps", "n"))
    t, cells = _cell_runs(t.take(pa.array(own)), "ascending")
    for x in (tps, n):
        for lo, hi in cells:
            x[lo:hi] = np.cumsum(x[lo:hi], axis=0) - x[lo:hi]
    return t.select([*CLASS, "_range", "cell"]).append_column("tps", _doubles(tps)).append_column("n", _doubles(n))


def _reached(key: tuple, rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """Of a range of a class, for each cell: its best precision, and the recall points reached with the best from there on."""
    rows = rows.sort_by("_at")
    w = _weights(rows)
    n_samples, all_tp, all_ignored = w.shape[1], rows.column("tp").to_numpy(), rows.column("ignored").to_numpy()
    told = offsets.to_pylist()
    out: dict[str, list] = {"cell": [o["cell"] for o in told], "peak": [np.zeros(n_samples) for _ in told], "sample": [[] for _ in told], "points": [[] for _ in told], "best": [[] for _ in told]}
    points = [_thresholds(np.maximum(np.array(o["npig"], float), 1)) for o in told]
    step = max(1, _ROOM // max(1, len(rows)))
    for lo in range(0, n_samples, step):
        some = slice(lo, lo + step)
        x = w[:, some].astype(float)
        all_n = np.cumsum(x, axis=0)
        for i, o in enumerate(told):
            at = np.flatnonzero((all_tp >> o["cell"]) & 1)  # precision only rises where a hit is
            if not len(at):
                continue
            out_of = (all_ignored >> o["cell"]) & 1
            n = (np.cumsum(x * (1 - out_of)[:, None], axis=0) if out_of.any() else all_n)[at]
            n += np.array(o["n"][some]) + _ULP
            before = np.array(o["tps"][some])
            tps = np.cumsum(x[at], axis=0)
            tps += before
            best = np.maximum.accumulate((tps / n)[::-1], axis=0)[::-1]
            out["peak"][i][some] = best[0]
            for k in range(tps.shape[1]):
                # the points that earlier ranges have not reached, and the hit that reaches each
                need = points[i][:, lo + k]
                place = np.searchsorted(tps[:, k], need[(need > before[k]) & (need <= tps[-1, k])])
                place, gained = np.unique(place, return_counts=True)
                out["sample"][i] += [lo + k] * len(place)
                out["points"][i] += gained.tolist()
                out["best"][i] += best[place, k].tolist()
    out["peak"] = [x.tolist() for x in out["peak"]]
    kinds = {"cell": pa.int32(), "peak": pa.list_(pa.float64()), "sample": pa.list_(pa.int64()), "points": pa.list_(pa.int64()), "best": pa.list_(pa.float64())}
    n = len(out["cell"])
    return pa.table(_own_key(offsets, n, [*CLASS, "_range"]) | {c: pa.array(out[c], kind) for c, kind in kinds.items()})


def _areas(t: pa.Table) -> pa.Table:
    """Of a class: for each cell the mean over the recall points of the best precision from there on, for each sample."""
    t, cells = _cell_runs(t, "descending")
    columns = [t.column(c).to_pylist() for c in ("peak", "sample", "points", "best")]
    out = []
    for lo, hi in cells:
        later = total = np.zeros(len(columns[0][lo]))
        for peak, sample, points, best in zip(*[c[lo:hi] for c in columns], strict=True):
            sample = np.array(sample, np.int64)
            got = np.bincount(sample, np.array(points, float) * np.maximum(np.array(best, float), later[sample]), len(later))
            total, later = total + got, np.maximum(later, peak)
        out.append(total / 101)
    firsts = pa.array([lo for lo, _ in cells])
    return pa.table({c: t.column(c).take(firsts) for c in (*CLASS, "cell")} | {"ap": _doubles(np.array(out))})


def sorted_detections(detections: DataFrame) -> DataFrame:
    """Rows (CLASS, score, image_id, det_ord, tp, ignored and others) by falling score in each class, in ranges."""
    return in_ranges(detections, *CLASS, F.desc("score"), "image_id", "det_ord")


def average_precisions(ranked: DataFrame, cells: int, objects: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """(CLASS, cell, ap), ap an array of a value for each sample; without a column weights there is one, of all images once.

    ranked: sorted_detections(), where bit k of tp and of ignored tells what a detection is in cell k. objects: (dataset,
    category_id, cell, npig), npig an array of the objects that count in each sample. sums: range_sums(), if there are any
    already. Classes without detections have no row.
    """
    kept = ["_range", "_at", "tp", "ignored", *(["weights"] if "weights" in ranked.columns else [])]
    rows = ranked.select(*CLASS, *kept)
    own = _own(ranked)
    if "weights" in ranked.columns:
        sums = rows.mapInArrow(lambda b: _weighted_sums(b, cells), f"{own}, _range long, cell int, tps array<double>, n array<double>")
    else:
        sums = (range_sums(ranked, cells) if sums is None else sums).select(*CLASS, "_range", "cell", *[F.array(F.col(c).cast("double")).alias(c) for c in ("tps", "n")])
    # with many samples a class's sums are dealt by cell as well
    by = [*CLASS, "cell"] if "weights" in ranked.columns else CLASS
    offsets = sums.groupBy(*by).applyInArrow(_before, f"{own}, _range long, cell int, tps array<double>, n array<double>").join(objects, ["dataset", "category_id", "cell"])
    key = [*CLASS, "_range"]
    told = f"{own}, _range long, cell int, peak array<double>, sample array<long>, points array<long>, best array<double>"
    reached = rows.groupBy(*key).cogroup(offsets.groupBy(*key)).applyInArrow(_reached, told)
    return reached.groupBy(*by).applyInArrow(_areas, f"{own}, cell int, ap array<double>")
