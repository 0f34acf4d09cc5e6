"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

A text's set is its distinct shingles of `shingle` words (A-Z lowered); texts with equal sets are one class, so copies
never meet each other again. Each class gets a sketch of `size` coordinates in rounds: in round i every shingle is hashed
to one coordinate and a value that starts at i, and a coordinate keeps the least it got; after `size` such rounds, round
size + j hashes everything to coordinate j, so that every coordinate fills. A text leaves the rounds as soon as all its
coordinates are filled, which for most texts is after two or three. Classes whose sketches agree on a band of `rows`
coordinates share a bucket.

Links are confirmed on the full sets as soon as they are looked at, a few bands first. In every bucket the first class (or
what it has become one component with) is held against one member of each other component, confirmed links make
components, and the other bands only see what is still apart: a large family costs a few pairs for each class. Then
buckets that still hold different components are searched as a whole, in blocks of bounded size: fingerprints tell which
members can be similar to one of another component, and those are compared on their full sets inside the task, which
returns a forest of links and never pairs. So every pair of a bucket is tested, or is in one component already. A pair
at the similarity `least` misses all bands with a probability of (1 - least**rows)**(size // rows), 3e-6 with the defaults.

Defined results: null texts and texts without words have an empty set and are linked with nothing; texts with fewer
words than a shingle have their whole word sequence as the one shingle; a row that occurs twice is linked with itself
and has one component; null ids count as the least possible id; tables without rows give none; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxyard.llm.batches import Rolling, byte_values, mix, ranges, text_blocks, word_bounds
from boxyard.llm.shared import integer, keep, keyed, row_keys

_ROLL = Rolling()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the sorted distinct shingles of each text of a block."""
    data = _LOWER[data]
    start, end, each = word_bounds(data, bounds)
    words = _ROLL.of(_ROLL.prefix(byte_values(data)), start, end) ^ mix((end - start).astype(np.uint64))
    prefix = _ROLL.prefix(words)
    first = np.cumsum(each) - each
    n = np.where(each >= k, each - k + 1, np.minimum(each, 1))
    at = ranges(first, n)
    size = np.repeat(np.minimum(each, k), n)
    h = _ROLL.of(prefix, at, at + size) ^ size.astype(np.uint64)
    text = np.repeat(np.arange(len(each)), n)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(each) + 1))


def sketches(h: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """One row of `size` coordinates for each set; sets without members give a row of the largest number."""
    n = len(bounds) - 1
    out = np.full((n, size), _TOP, np.uint64)
    flat = out.ravel()
    open_sets = np.flatnonzero(np.diff(bounds) > 0)
    low = np.uint64((1 << 53) - 1)
    for i in range(2 * size):
        if not len(open_sets):
            break
        length = bounds[open_sets + 1] - bounds[open_sets]
        x = mix(h[ranges(bounds[open_sets], length)] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        spot = (x >> np.uint64(40)) % np.uint64(size) if i < size else np.full(len(x), i - size, np.uint64)
        value = (np.uint64(i) << np.uint64(53)) | (mix(x) & low)
        np.minimum.at(flat, (np.repeat(open_sets * size, length) + spot.astype(np.int64)), value)
        open_sets = open_sets[(out[open_sets] == _TOP).any(axis=1)]
    return out


def _sketch_rows(batches: Iterator[pa.RecordBatch], k: int, size: int, rows: int) -> Iterator[pa.RecordBatch]:
    bands = size // rows
    for got, data, bounds in text_blocks(batches):
        h, b = shingle_sets(data, bounds, k)
        s = sketches(h, b, size)
        n = np.diff(b)
        # two independent sums over a sorted set tell sets apart
        run = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x51, 0xA7)]
        sig = [mix((r[b[1:]] - r[b[:-1]]) + n.astype(np.uint64)).view(np.int64) for r in run]
        folded = s[:, : bands * rows].reshape(-1, bands, rows)
        key = np.zeros(folded.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + folded[:, :, j])
        bits = (mix(s[:, :256]) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(np.pad(bits, ((0, 0), (0, 256 - bits.shape[1]))), axis=1).view(np.int64)
        full = n > 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * bands, bands, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
        yield pa.record_batch(
            [got.column(0), got.column(1), pa.array(n.astype(np.int64)), pa.array(sig[0], mask=~full), pa.array(sig[1], mask=~full), pa.array(packed[:, 0]), pa.array(packed[:, 1]), lists, pa.array(packed[:, 2]), pa.array(packed[:, 3])],
            ["_id", "_t", "n", "s1", "s2", "f1", "f2", "bands", "f3", "f4"],
        )


def _set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for got, data, bounds in text_blocks(batches):
        h, b = shingle_sets(data, bounds, k)
        yield pa.record_batch([got.column(0), pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(h.view(np.int64)))], ["cls", "members"])


def _most_off(size: int, least: float) -> int:
    """Bits in which the fingerprints of two sets of the similarity `least` may differ: eight deviations more than expected."""
    n = min(256, size)
    want = n * (1 + least) / 2
    floor = want - 8 * (n * (1 + least) / 2 * (1 - least) / 2) ** 0.5
    return int(n - floor) + 1


def _sets_of(classes: DataFrame, where: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cls, members) of the wanted classes, from one text of each: the only time that texts are looked up again."""
    texts = docs.select("_id", "_t", "text").join(where.join(classes, "cls").select("cls", "_id", "_t").hint("merge"), ["_id", "_t"]).select("cls", "text")
    return keep(texts.mapInArrow(lambda x: _set_rows(x, k), "cls long, members array<long>").dropDuplicates(["cls"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those with 100 * intersection >= percent * union, on the full sets."""
    left = pairs.join(sets.withColumnRenamed("cls", "a").withColumnRenamed("members", "ma"), "a")
    both = left.join(sets.withColumnRenamed("cls", "b").withColumnRenamed("members", "mb"), "b")
    same = F.size(F.array_intersect("ma", "mb"))
    return both.where(F.lit(100) * same >= F.lit(percent) * (F.size("ma") + F.size("mb") - same)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that the links (a, b) connect each node with.

    Every round, each node joins its least neighbour and that one's least neighbour, and links between what has become
    one node are dropped, so the links shrink quickly. The least node of a component always stays itself, and is the
    root when no link is left. Only whether any link is left comes to the driver.
    """
    edges = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    total = None
    while True:
        near = edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node")
        up = near.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = keep(near.join(up, F.col("root") == F.col("_n"), "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("root")), "step")
        moved = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        total = step if total is None else keep(total.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = keep(left.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return total


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after further links between nodes; nodes without links may be missing."""
    if roots is None:
        return components(links)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    new = components(lifted)
    moved = new.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    old = roots.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return keep(old.unionByName(new.join(roots.select("node"), "node", "left_anti").select("node", "root")), "joined")


def _with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds to rows with a class its root, which is the class itself where it has no link yet."""
    if roots is None:
        return members.withColumn("root", F.col("cls"))
    return members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _stars(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs (a, b): in every bucket, a member of each component and the first member; one pair of each two components."""
    each = _with_roots(buckets, roots).groupBy("bucket", "root").agg(F.min("cls").alias("cls"))
    head = each.groupBy("bucket").agg(F.min(F.struct("root", "cls")).alias("h")).select("bucket", F.col("h.root").alias("_root"), F.col("h.cls").alias("a"))
    apart = each.join(head, "bucket").where(F.col("root") != F.col("_root"))
    return apart.groupBy("_root", "root").agg(F.min(F.struct(F.xxhash64("a", "cls"), "a", F.col("cls").alias("b"))).alias("p")).select("p.a", "p.b")


def _groups(d: DataFrame, shingle: int, percent: int, size: int, rows: int) -> DataFrame:
    """(_id, _t, n, low, low_t) of the distinct rows of keyed(): the set's size, and the first text of the component (null for empty sets)."""
    least = percent / 100
    rows_ = keep(
        d.select("_id", "_t", "text").mapInArrow(lambda b: _sketch_rows(b, shingle, size, rows), "_id long, _t long, n long, s1 long, s2 long, f1 long, f2 long, bands array<long>, f3 long, f4 long"),
        "sketches",
    )
    # a class is all texts with one set; it is called by the least id that has it, and the first of its texts is read again
    classes = rows_.where(F.col("s1").isNotNull()).groupBy("s1", "s2").agg(F.min(F.struct("_id", "_t")).alias("p"), F.max("n").alias("n"), F.max("f1").alias("f1"), F.max("f2").alias("f2"), F.max("f3").alias("f3"), F.max("f4").alias("f4"), F.min("bands").alias("bands"))
    # two sets can share the least id only where an id occurs with different texts: the hash then tells them apart
    classes = keep(classes.select("s1", "s2", F.xxhash64("s1", "s2").alias("cls"), F.col("p._id").alias("_id"), F.col("p._t").alias("_t"), "n", "f1", "f2", "f3", "f4", "bands"), "classes")
    buckets = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("bucket")
    buckets = keep(buckets.join(crowded, "bucket"), "buckets")
    sets = _sets_of(buckets.select("cls").distinct(), classes.select("cls", "_id", "_t"), d, shingle)
    root = None
    for some in (F.col("band") < _FIRST_BANDS, F.col("band") >= _FIRST_BANDS):
        links = keep(_confirmed(keep(_stars(buckets.where(some), root), "stars"), sets, percent), "links")
        root = joined(root, links)
    links = keep(_search(buckets, root, classes.select("cls", "n", "f1", "f2", "f3", "f4"), sets, size, percent), "forest")
    root = joined(root, links)
    named = classes.join(root, classes["cls"] == root["node"], "left").select("s1", "s2", "_id", "_t", F.coalesce("root", "cls").alias("root"))
    low = named.groupBy("root").agg(F.min(F.struct("_id", "_t")).alias("p")).select("root", F.col("p._id").alias("low"), F.col("p._t").alias("low_t"))
    named = named.join(low, "root").select("s1", "s2", "low", "low_t")
    return rows_.select("_id", "_t", "n", "s1", "s2").distinct().join(named, ["s1", "s2"], "left").select("_id", "_t", "n", "low", "low_t")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, size: int = 252, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; kept is true for the least id of a component.

    Ids that are no integers have the order of their hashes.
    """
    d = keyed(docs, id_col, text_col)
    out = d.select("doc_id", "_id", "_t").join(_groups(d, shingle, percent, size, rows), ["_id", "_t"])
    if integer(docs, id_col):
        first = F.col("low").cast(docs.schema[id_col].dataType)
    else:
        names = d.select(F.col("_id").alias("low"), F.col("_t").alias("low_t"), F.col("doc_id").alias("_first")).distinct()
        out = out.join(names, ["low", "low_t"], "left")
        first = F.col("_first")
    root_id = F.when(F.col("low").isNotNull(), first).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), root_id.alias("component_id"), F.coalesce(F.col("low").isNull() | (F.col("_id") == F.col("low")), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, size: int = 252, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns: of each component its first text (by id), once, and every text without words once."""
    d = keyed(docs, id_col, text_col)
    g = _groups(d, shingle, percent, size, rows)
    g = g.where(F.col("low").isNull() | ((F.col("_id") == F.col("low")) & (F.col("_t") == F.col("low_t")))).select(F.col("_id").alias("_i"), F.col("_t").alias("_h"))
    own = row_keys(docs, id_col, text_col)
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own[0].alias("_i"), own[1].alias("_h")).join(g, ["_i", "_h"])
    return kept.dropDuplicates(["_i", "_h"]).select("row.*")


#: Bands that are looked at first.
_FIRST_BANDS = 4

#: Members, and shingles in all, of a block of a bucket, of which two meet in a task.
_BLOCK, _BLOCK_SHINGLES = 1000, 500_000


def _groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that arrive in the order of their first `keys` columns, as one table for each value of these."""
    held: list[pa.RecordBatch] = []
    for got in batches:
        if not len(got):
            continue
        cols = [got.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(len(got), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            new[0] = any(last.column(i)[len(last) - 1] != got.column(i)[0] for i in range(keys))
        at = [0, *np.flatnonzero(new).tolist(), len(got)] if not new[0] else [*np.flatnonzero(new).tolist(), len(got)]
        if held and new[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in itertools.pairwise(at):
            if hi == lo:
                continue
            held.append(got.slice(lo, hi - lo))
            if hi < len(got):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _screen(batches: Iterator[pa.RecordBatch], most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of two blocks of a bucket: the members whose fingerprint leaves them similar to one of another component.

    The group that they form is called by a hash of its members, so equal groups of several bands are compared once.
    """
    for t in _groups_of(batches, 3):
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        mine, cls, root, n = (t.column(c).to_numpy() for c in ("mine", "cls", "root", "n"))
        f = [t.column(f"f{k}").to_numpy().view(np.uint64) for k in range(1, 5)]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        some = np.zeros(len(cls), bool)
        step = max(1, 1_000_000 // max(1, len(right)))
        for lo in range(0, len(left), step):
            x = left[lo : lo + step]
            off = sum(np.bitwise_count(y[x][:, None] ^ y[right][None, :]).astype(np.int16) for y in f)
            sizes = n[x][:, None], n[right][None, :]
            ok = (off <= most) & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)) & (root[x][:, None] != root[right][None, :])
            some[x] |= ok.any(axis=1)
            some[right] |= ok.any(axis=0)
        if not some.any():
            continue
        side = np.where(mine == j, 1, 0)[some] if i != j else np.zeros(int(some.sum()), np.int64)
        cls, root = cls[some], root[some]
        with np.errstate(over="ignore"):
            name = mix(np.array([mix(mix(cls.view(np.uint64)) + side.astype(np.uint64)).sum(dtype=np.uint64)])).view(np.int64)[0]
        yield pa.record_batch([pa.array(np.full(len(cls), name)), pa.array(cls), pa.array(root), pa.array(side.astype(np.int32)), pa.array(np.full(len(cls), i != j))], ["g", "cls", "root", "side", "two"])


def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the components of a group's members, confirmed on the full sets: at most one less than members."""
    for t in _groups_of(batches, 1):
        cls, label, side = (t.column(c).to_numpy() for c in ("cls", "root", "side"))
        label, two = label.copy(), t.column("two")[0].as_py()
        sets = t.column("members").combine_chunks()
        flat, at = sets.values.to_numpy(), sets.offsets.to_numpy().astype(np.int64)
        flat, at = flat[at[0] : at[-1]], at - at[0]
        n = np.diff(at)
        _, token = np.unique(flat, return_inverse=True)
        has = np.zeros(int(token.max(initial=0)) + 1, bool)
        out = []
        for i in range(len(cls)):
            open_ = label != label[i]
            open_[: i + 1] = False
            if two:
                open_ &= side != side[i]
            if not open_.any():
                continue
            has[token[at[i] : at[i + 1]]] = True
            both = np.add.reduceat(has[token], at[:-1], dtype=np.int64)
            has[token[at[i] : at[i + 1]]] = False
            for j in np.flatnonzero(open_ & (100 * both >= percent * (n[i] + n - both))).tolist():
                if label[j] != label[i]:
                    out.append((cls[i], cls[j]))
                    label[label == label[j]] = label[i]
        if out:
            ab = np.array(out, np.int64)
            yield pa.record_batch([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def _search(buckets: DataFrame, roots: DataFrame, prints: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that make one component of all similar members of a bucket; buckets of one component are left alone."""
    b = _with_roots(buckets.select("bucket", "cls"), roots)
    torn = b.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    b = keep(b.join(torn, "bucket").join(prints, "cls"), "torn")
    many = b.groupBy("bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(_BLOCK)), F.sum("n") / F.lit(float(_BLOCK_SHINGLES)))).cast("int").alias("blocks"))
    b = b.join(many, "bucket").withColumn("mine", F.pmod(F.xxhash64("cls", "bucket"), "blocks").cast("int"))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = b.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "root", "n", "f1", "f2", "f3", "f4")
    most = _most_off(size, percent / 100)
    met = b.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lambda x: _screen(x, most, percent), "g long, cls long, root long, side int, two boolean")
    met = keep(met.distinct(), "met")
    full = met.join(sets, "cls").select("g", "cls", "root", "side", "two", "members")
    return full.repartition("g").sortWithinPartitions("g").mapInArrow(lambda x: _forest(x, percent), "a long, b long")
