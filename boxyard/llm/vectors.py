"""Near-duplicate vectors: a pigeonhole join over the subspaces of rotated vectors.

Unit vectors with a cosine of at least `least` are at most 2 - 2 * least apart, in squared distance. Vectors are turned by one
random rotation, so that no coordinate stands out, and split into blocks of `width` coordinates. Whatever the distance, some
block has at most its share of it, so two vectors that are near are within a block's budget in at least one block. Each
block is a range join: space is cut into cells at quantiles of the coordinates, into more cells the more vectors a label
has; a vector is in its own cell and visits those of lower number that its ball of the budget reaches. A cell with more
than `most` vectors is cut into parts, and every two parts meet in a task of their own.

A task has the whole vectors of its cell, so candidates are verified where they are found and are never written: it returns
the number of links of each vector and a forest of them. A pair is counted in the first block that has it within its budget,
so it counts once. Products of matrices decide what is clear; where a value is within 1e-9 of a bound, sums over the pair
itself decide, the same in every task.

Equal vectors of a label are one vector with a multiplicity from the start.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, are linked
with nothing; vectors of different lengths are never linked; a row that occurs twice is linked with itself; of a
component's ids null ones are never the smallest; a vector without links is its own component, also with a null id; an
empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxyard.llm.neardup import components
from boxyard.llm.shared import keep

#: Distance to a bound from which on a product of matrices is trusted.
_CLEAR = 1e-9


@functools.lru_cache(4)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made but for rounding."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int, width: int) -> list[slice]:
    return [slice(i, min(i + width, d)) for i in range(0, d, width)]


def budget(least: float, size: int, d: int) -> float:
    """The share of the squared distance of a block of `size` of d coordinates, with room for the rounding of coordinates."""
    return (2 - 2 * least) * size / d * (1 + 1e-4) + 1e-7


def matrix(col: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(col), -1)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of large or small numbers would not be finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@functools.lru_cache(64)
def _cuts(bits: int, d: int) -> np.ndarray:
    """Bounds that cut a coordinate of a random unit vector into 2**bits about equal parts."""
    n = 1 << bits
    return np.array([NormalDist().inv_cdf(j / n) for j in range(1, n)]) / math.sqrt(d)


def visits(x: np.ndarray, total: int, most: int, d: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own) for points x of a block: the cell of each, and the cells of lower number within the squared distance `reach`."""
    n, w = x.shape
    depth = min(max(0, math.ceil(math.log2(max(1, total) / most))), 6 * w)
    row, cell, off = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    own = np.zeros(n, np.int64)
    r = math.sqrt(reach)
    for t in range(w):
        bits = depth // w + (t < depth % w)
        if not bits:
            continue
        cuts = _cuts(bits, d)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        mine = np.searchsorted(cuts, x[:, t], "right")
        lo, hi = np.searchsorted(cuts, x[:, t] - r, "right"), np.searchsorted(cuts, x[:, t] + r, "right")
        own = (own << bits) + mine
        count = (hi - lo + 1)[row]
        at = np.repeat(np.arange(len(row)), count)
        c = lo[row][at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        row = row[at]
        away = np.maximum(0, np.maximum(x[row, t] - edges[c + 1], edges[c] - x[row, t]))
        cell, off = (cell[at] << bits) + c, off[at] + away * away
        near = off <= reach
        row, cell, off = row[near], cell[near], off[near]
    low = cell <= own[row]
    row, cell = row[low], cell[low]
    return row, cell, cell == own[row]


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        out = np.empty(len(t), object)
        sizes = t.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            some = np.flatnonzero(sizes == d)
            out[some] = list((units(matrix(t.column(1).take(pa.array(some)), np.float64)) @ rotation(int(d))).astype(np.float32))
        yield pa.record_batch([t.column(0), pa.array(out.tolist(), pa.list_(pa.float32()))], ["rid", "turned"])


def _routed(batches: Iterator[pa.RecordBatch], least: float, width: int, most: int) -> Iterator[pa.RecordBatch]:
    for t in batches:
        sizes = t.column("turned").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        totals = t.column("total").to_numpy()
        rid = t.column("rid").to_numpy()
        for d, total in np.unique(np.stack([sizes, totals], axis=1), axis=0).tolist():
            some = np.flatnonzero((sizes == d) & (totals == total))
            x = matrix(t.column("turned").take(pa.array(some)), np.float64)
            for k, part in enumerate(blocks(d, width)):
                row, cell, own = visits(x[:, part], total, most, d, budget(least, part.stop - part.start, d))
                yield pa.record_batch([pa.array(rid[some[row]]), pa.array(np.full(len(row), k, np.int32)), pa.array(cell), pa.array(own)], ["rid", "block", "cell", "own"])


def links_of(vectors: np.ndarray, turned: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, width: int, least: float) -> np.ndarray:
    """Which of left (rows) are linked with which of right (columns), among pairs that are counted in this block."""
    d = vectors.shape[1]
    parts = blocks(d, width)
    lim = [budget(least, p.stop - p.start, d) for p in parts]
    u = units(vectors)
    cos = u[left] @ u[right].T
    out = cos >= least - _CLEAR
    if not out.any():
        return out
    unclear = np.abs(cos - least) < _CLEAR
    for k in range(block + 1):
        x, y = turned[left, parts[k]], turned[right, parts[k]]
        off = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        out &= (off <= lim[k] + _CLEAR) if k == block else (off > lim[k] - _CLEAR)
        unclear |= np.abs(off - lim[k]) < _CLEAR
    i, j = np.nonzero(out & unclear)
    step = max(1, 2_000_000 // d)
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        va, vb = vectors[left[a]], vectors[right[b]]
        exact = (va * vb).sum(axis=1) / (np.sqrt((va * va).sum(axis=1)) * np.sqrt((vb * vb).sum(axis=1)))
        gap = turned[left[a]] - turned[right[b]]
        ok = exact >= least
        for k in range(block + 1):
            off = np.zeros(len(a))
            for c in range(parts[k].start, parts[k].stop):
                off += gap[:, c] * gap[:, c]
            ok &= (off <= lim[k]) if k == block else (off > lim[k])
        out[a, b] = ok
    return out


def _met(t: pa.Table, least: float, width: int) -> pa.Table:
    """(rid, root, n) of the vectors of two parts of a cell that have links: a vector of their component, and the rows linked."""
    block, i, j = (t.column(c)[0].as_py() for c in ("block", "i", "j"))
    part, own, times = t.column("part").to_numpy(), t.column("own").to_numpy(), t.column("times").to_numpy().astype(float)
    vectors, turned = matrix(t.column("vector"), np.float64), matrix(t.column("turned"), np.float64)
    rid = t.column("rid").to_numpy()
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    label, n = np.arange(len(rid)), np.zeros(len(rid))
    step = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        x = left[at : at + step]
        a = links_of(vectors, turned, x, right, block, width, least)
        a &= own[x][:, None] | own[right][None, :]  # two visitors meet elsewhere
        if i == j:
            a &= x[:, None] < right[None, :]
        n[x] += a @ times[right]
        n[right] += times[x] @ a
        for r in np.flatnonzero(a.any(axis=1)).tolist():
            met = label[right[a[r]]]
            if (met != label[x[r]]).any():
                met = np.append(met, label[x[r]])
                label[np.isin(label, met)] = met.min()
    some = np.flatnonzero(n)
    return pa.table({"rid": pa.array(rid[some]), "root": pa.array(rid[label[some]]), "n": pa.array(n[some].astype(np.int64))})


def near_vectors(table: DataFrame, least: float = 0.98, width: int = 8, most: int = 2000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: the other vectors of its label with a cosine of at least `least`."""
    d = table.select(table[id_col].alias("vec_id"), table[label_col].alias("label"), table[vector_col].alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.withColumn("usable", F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    classes = d.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("times")).withColumn("rid", F.monotonically_increasing_id())
    classes = keep(classes.withColumn("size", F.size("vector")), "vectors")
    turned = keep(classes.select("rid", "vector").mapInArrow(_turned, "rid long, turned array<float>").join(classes.select("rid", "label", "size"), "rid"), "turned")
    totals = turned.groupBy("label", "size").agg(F.count(F.lit(1)).alias("total"))
    routes = turned.join(totals, ["label", "size"]).select("rid", "turned", "total").mapInArrow(lambda b: _routed(b, least, width, most), "rid long, block int, cell long, own boolean")
    routes = keep(routes.join(classes.select("rid", "label", "size"), "rid"), "routes")
    cell = ["label", "size", "block", "cell"]
    # a cell that only visitors reach, or only one vector, has no pair
    full = routes.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.count_if("own").alias("_own")).where((F.col("_n") > 1) & (F.col("_own") > 0)).select(*cell, F.ceil(F.col("_n") / most).cast("int").alias("parts"))
    rows = routes.join(full, cell).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "_o"), "j": F.greatest("part", "_o")})
    rows = rows.select("rid", *cell, "i", "j", "part", "own").join(classes.select("rid", "times", "vector"), "rid").join(turned.select("rid", "turned"), "rid")
    found = keep(rows.groupBy(*cell, "i", "j").applyInArrow(lambda t: _met(t, least, width), "rid long, root long, n long"), "links")
    n = found.groupBy("rid").agg(F.sum("n").alias("n"))
    roots = components(found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")).distinct())
    named = classes.select("rid", "label", "vector", "low", "times").join(n, "rid", "left").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least_id = named.groupBy("root").agg(F.min("low").alias("least_id"))
    named = named.join(least_id, "root").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), "least_id", F.lit(True).alias("usable"))
    out = d.join(named, ["label", "vector", "usable"], "left")
    component = F.coalesce("least_id", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
c(vec_id, root) as (select vec_id, vec_id from embeddings union select l.b, c.root from c join l on c.vec_id = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, min(c.root) as component_id, min(c.root) = e.vec_id as kept
from embeddings e join c on c.vec_id = e.vec_id group by e.vec_id
"""
