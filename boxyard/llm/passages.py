"""Substring dedup by words with a count-min prefilter.

Windows are estimated by the count of their anchor (runs.py): all copies of a window have the same anchor, so the
anchor's count is never below the window's. Each partition makes a sketch of its anchors, the sketches are merged by
adding their cells, and a window whose cells all count two or more is estimated repeated. The sketch is kept in its
sparse form, as rows (cell, count), so it is spread over the cluster and grows with the corpus instead of being sent
to every task; its second row counts only what the first one let through, which loses nothing, as every copy of a
repeated window passes. The second pass groups exactly the windows that passed: first whole runs by their hash, then,
where an anchor has different runs, single windows.

Defined results: null texts have no words; texts below `window` words lose nothing; a row that occurs twice is two
texts; tables without rows give none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxyard.llm import runs as R
from boxyard.llm.batches import ranges, text_blocks
from boxyard.llm.shared import keep, keyed


def estimated_repeated(runs: DataFrame, bits: int = 28) -> DataFrame:
    """The runs whose anchor a sketch of two rows of 2**bits cells counts twice or more."""

    def row(d: DataFrame, cell: Column) -> DataFrame:
        d = d.withColumn("_cell", cell)
        merged = d.groupBy("_cell").agg(F.sum("times").alias("n"))  # each partition's sketch first, then their sum
        return d.join(merged.where(F.col("n") > 1).select("_cell"), "_cell").drop("_cell")

    mask = F.lit((1 << bits) - 1)
    kind = "int" if bits < 31 else "long"
    first = keep(row(runs, F.col("h").bitwiseAND(mask).cast(kind)), "sketched")
    return row(first, F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - bits)).cast(kind))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the wanted runs."""
    for rows, data, bounds in text_blocks(batches):
        values, b = R.word_symbols(data, bounds)
        at_runs, flat = R.lists_of(rows, "runs")
        h, run, c, at, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        if not len(h):
            continue
        base = np.repeat(b[:-1], np.diff(at_runs)) + at
        start = ranges(base, n.astype(np.int64))
        prefix = R._ROLL.prefix(values)
        w = R._ROLL.of(prefix, start, start + window).view(np.int64)
        i = (start - np.repeat(base, n)).astype(np.int32)
        yield pa.record_batch([pa.array(np.repeat(h, n)), pa.array(np.repeat(run, n)), pa.array(np.repeat(c, n)), pa.array(w), pa.array(i)], ["h", "run", "c", "w", "i"])


def find_repeats(d: DataFrame, window: int, part: int, bits: int) -> DataFrame:
    """(_id, _t, hits): the repeated windows of each text that has any; d comes from keyed()."""
    runs = keep(estimated_repeated(R.run_table(d, R.word_symbols, window, part), bits), "runs")
    distinct = keep(R.distinct_runs(runs), "distinct")
    copied = distinct.where(F.col("c") > 1).select("h", "run", F.array(F.lit(0), F.col("n")).alias("hits"))
    mixed = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("h")
    single = keep(R.with_texts(d, distinct.join(mixed, "h")).mapInArrow(lambda b: _windows(b, window), "h long, run long, c long, w long, i int"), "windows")
    twice = single.groupBy("h", "w").agg(F.sum("c").alias("n")).where(F.col("n") > 1).select("h", "w")
    some = single.where(F.col("c") == 1).join(twice, ["h", "w"]).groupBy("h", "run").agg(F.flatten(F.collect_list(F.array(F.col("i"), F.col("i") + 1))).alias("hits"))
    return R.hits_by_text(runs, copied.unionByName(some))


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches):
        at, flat = R.lists_of(rows, "hits")
        flat = flat.to_numpy(zero_copy_only=False)
        raw = data.tobytes()
        sizes, removed, shas, texts = [], [], [], []
        for i in range(len(rows)):
            words = raw[bounds[i] : bounds[i + 1]].split()
            sizes.append(len(words))
            n_cut = 0
            if at[i + 1] > at[i]:
                mask = R.covered(flat[at[i] : at[i + 1]], window, len(words))
                n_cut = int(mask.sum())
                words = [words[k] for k in np.flatnonzero(~mask).tolist()]
            text = b" ".join(words)
            removed.append(n_cut)
            shas.append(hashlib.sha256(text).hexdigest())
            texts.append(text)
        ids = rows.column(rows.schema.get_field_index("doc_id"))
        yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = 35, part: int = 18, bits: int = 28, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of docs; `kept` has the remaining words.

    bits: 2**bits cells in each row of the sketch. A larger corpus wants more; fewer only let more windows through.
    """
    d = keyed(docs, id_col, text_col)
    hits = find_repeats(d, window, part, bits)
    joined = d.join(hits.hint("merge"), ["_id", "_t"], "left").select("doc_id", "text", "hits")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(lambda b: _cut(b, window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("doc_id", id_col)
