"""Suffix-array dedup: removal of every byte covered by a string of `window` bytes that starts more than once.

Runs of windows with one anchor (runs.py) are counted; runs whose anchor repeats are the only places where a window can
repeat. One text of each distinct run goes to the shard of its anchor, with the number of its copies. A shard is a few
MB of such texts: its suffix array is induced from the sorted leftmost-smaller substrings, and a window repeats if its
run has copies or its permuted common prefix with a neighbour is long enough. What a shard finds is joined back to
every place of the run.

An anchor with more distinct runs than a shard takes (a passage that very many different texts share) is not sorted
as a suffix array: the windows of its runs are grouped by hash, an exact path that Spark can split.

Defined results: null texts are empty; texts below `window` bytes lose nothing; a row that occurs twice (same id and
text) is two texts, so each repeats the other; tables without rows give none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxyard.llm import runs as R
from boxyard.llm import suffix
from boxyard.llm.batches import Rolling, byte_values, text_blocks
from boxyard.llm.shared import keep, keyed

#: Stands between the texts of a shard; no UTF-8 text has it.
_END = 0xFF


def _extract(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Texts of the wanted runs."""
    for rows, data, bounds in text_blocks(batches):
        at_runs, flat = R.lists_of(rows, "runs")
        h, run, c, at, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        base = np.repeat(bounds[:-1], np.diff(at_runs)) + at
        raw = data.tobytes()
        pieces = [raw[b : b + k] for b, k in zip(base.tolist(), (n + window - 1).tolist(), strict=True)]
        yield pa.record_batch([pa.array(h), pa.array(run), pa.array(c), pa.array(pieces, pa.binary())], ["h", "run", "c", "piece"])


def _intervals(mask: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.tolist()


FOUND = "h long, run long, hits array<int>, w long, c long"


def _search(batches: Iterator[pa.RecordBatch], window: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive by anchor. Gives hits of runs; for anchors beyond a shard, one row for each window instead."""
    roll = Rolling()

    def out(h, run, hits, w, c):
        return pa.record_batch([pa.array(h, pa.int64()), pa.array(run, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(w, pa.int64()), pa.array(c, pa.int64())], ["h", "run", "hits", "w", "c"])

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(bytes([_END]).join(r[3] for r in rows), np.uint8)
        flags = suffix.repeated(data, window)
        size = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
        start = np.cumsum(size + 1) - size - 1
        found = [(r[0], r[1], [0, len(r[3]) - window + 1] if r[2] > 1 else _intervals(flags[s : s + k - window + 1])) for r, s, k in zip(rows, start.tolist(), size.tolist(), strict=True)]
        found = [f for f in found if f[2]]
        return out([f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [None] * len(found), [None] * len(found))

    def windows(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
        n = size - window + 1
        start = np.cumsum(size) - size
        prefix = roll.prefix(byte_values(data))
        at = np.repeat(start, n) + np.concatenate([np.arange(k) for k in n.tolist()])
        w = roll.of(prefix, at, at + window).view(np.int64)
        i = (at - np.repeat(start, n)).astype(np.int32)
        hits = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(i) + 1, 2, dtype=np.int32)), pa.array(np.stack([i, i + 1], 1).ravel()))
        rep = lambda k: np.repeat(np.array([r[k] for r in rows], np.int64), n)
        return pa.record_batch([pa.array(rep(0)), pa.array(rep(1)), hits, pa.array(w), pa.array(rep(2))], ["h", "run", "hits", "w", "c"])

    shard: list[tuple] = []  # anchors that are complete
    own: list[tuple] = []  # the anchor at hand
    total = held = 0
    last, large = None, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != last:
                if large and own:
                    yield windows(own)
                elif own:
                    if total + held > shard_bytes and shard:
                        yield sort(shard)
                        shard, total = [], 0
                    shard, total = shard + own if len(own) > 50 else (shard.extend(own) or shard), total + held
                own, held, large, last = [], 0, False, row[0]
            own.append(row)
            held += len(row[3])
            if held > shard_bytes // 2:
                large = True
            if large and held > 200_000:
                yield windows(own)
                own, held = [], 0
    if large and own:
        yield windows(own)
    elif own:
        shard = shard + own
    if shard:
        yield sort(shard)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches):
        at, flat = R.lists_of(rows, "hits")
        flat = flat.to_numpy(zero_copy_only=False)
        sizes, removed, spans, shas, texts = [], [], [], [], []
        raw = data.tobytes()
        for i in range(len(rows)):
            text = raw[bounds[i] : bounds[i + 1]]
            n_cut = n_spans = 0
            if at[i + 1] > at[i]:
                mask = R.covered(flat[at[i] : at[i + 1]], window, len(text))
                n_cut = int(mask.sum())
                n_spans = len(_intervals(mask)) // 2
                text = np.frombuffer(text, np.uint8)[~mask].tobytes()
            sizes.append(int(bounds[i + 1] - bounds[i]))
            removed.append(n_cut)
            spans.append(n_spans)
            texts.append(text)
            shas.append(hashlib.sha256(text).hexdigest())
        ids = rows.column(rows.schema.get_field_index("doc_id"))
        yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def find_repeats(d: DataFrame, window: int, part: int, shard_bytes: int) -> DataFrame:
    """(_id, _t, hits): the repeated windows of each text that has any; d comes from keyed()."""
    runs = R.run_table(d, R.byte_symbols, window, part)
    again = runs.groupBy("h").agg(F.sum("times").alias("c")).where(F.col("c") > 1).select("h")
    runs = keep(runs.join(again, "h"), "runs")
    texts = R.with_texts(d, R.distinct_runs(runs)).mapInArrow(lambda b: _extract(b, window), "h long, run long, c long, piece binary")
    texts = texts.repartition("h").sortWithinPartitions("h")
    found = keep(texts.mapInArrow(lambda b: _search(b, window, shard_bytes), FOUND), "found")
    single = found.where(F.col("w").isNotNull())
    twice = single.groupBy("h", "w").agg(F.sum("c").alias("n")).where(F.col("n") > 1).select("h", "w")
    single = single.join(twice, ["h", "w"]).groupBy("h", "run").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return R.hits_by_text(runs, found.where(F.col("w").isNull()).select("h", "run", "hits").unionByName(single))


def remove_repeats(docs: DataFrame, window: int = 200, part: int = 32, shard_bytes: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row of docs.

    `kept` has the remaining bytes; a cut may fall inside a character, so they are bytes, not a string.
    """
    d = keyed(docs, id_col, text_col)
    hits = find_repeats(d, window, part, shard_bytes)
    joined = d.join(hits.hint("merge"), ["_id", "_t"], "left").select("doc_id", "text", "hits")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(lambda b: _cut(b, window), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("doc_id", id_col)
