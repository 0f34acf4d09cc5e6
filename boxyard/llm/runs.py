"""Cutting texts into runs of windows that repeat together, for the exact search of repeated windows.

A window is `window` consecutive symbols (bytes or words). Its anchor is the least-hashed of its sub-windows of
`part` symbols, the first of equals; equal windows have equal anchors at equal offsets. Windows that follow each other
mostly share their anchor, so a text falls into runs of windows with one anchor each. A window can only repeat where
its anchor's hash repeats, and all its copies lie in runs of that hash.

Where a text repeats itself with a short period, the anchor moves once in each period and every run is the one before it
again. Such runs are one row with the number of `times` it follows itself, so that a text of padding is a few rows, not
one row a byte; windows of a run that follows itself are repeated by that alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxyard.llm.batches import Rolling, byte_values, mix, ranges, text_blocks, window_min, word_bounds

#: Windows of a longer text are taken in pieces of so many, so that memory stays bounded.
PIECE = 1 << 22

_ROLL = Rolling()


def byte_symbols(data: np.ndarray, bounds: np.ndarray):
    """(a number for each byte, symbol bounds of each text)"""
    return byte_values(data), bounds


def word_symbols(data: np.ndarray, bounds: np.ndarray):
    """(a hash of each word, symbol bounds of each text)"""
    start, end, each = word_bounds(data, bounds)
    prefix = _ROLL.prefix(byte_values(data))
    h = _ROLL.of(prefix, start, end) ^ mix((end - start).astype(np.uint64))
    return h, np.concatenate([[0], np.cumsum(each)])


def runs_of(values: np.ndarray, bounds: np.ndarray, window: int, part: int):
    """(text, first window relative to its text, number of windows, anchor hash, hash of the run's symbols) of all runs."""
    outs = []
    step = PIECE
    for lo in range(0, max(1, len(values)), step):
        # texts are cut only where a block is longer than a piece; the last window of a piece reaches beyond it
        piece = values[lo : lo + step + window - 1]
        b = np.clip(bounds - lo, 0, len(piece))
        first = np.clip(bounds[:-1] - lo, 0, None)
        n_win = np.minimum(np.maximum(b[1:] - window + 1, 0), step) - first
        n_win = np.where(n_win > 0, n_win, 0)
        starts = ranges(first, n_win)
        if not len(starts):
            continue
        prefix = _ROLL.prefix(piece)
        parts = _ROLL.windows(prefix, part)
        at = window_min(parts, window - part + 1)[starts]
        text = np.repeat(np.arange(len(first)), n_win)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        i = np.flatnonzero(new)
        n = np.diff(np.append(i, len(starts)))
        s = starts[i]
        run = _ROLL.of(prefix, s, s + n + window - 1)
        outs.append((text[i], s + lo - bounds[text[i]], n, mix(parts[at[i]]), run))
    if not outs:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def folded(text: np.ndarray, at: np.ndarray, n: np.ndarray, h: np.ndarray, run: np.ndarray):
    """The same columns, runs that follow themselves written once, and how many times each follows."""
    if not len(text):
        return text, at, n, h, run, np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (run[1:] != run[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (at[1:] != at[:-1] + n[:-1])
    i = np.flatnonzero(new)
    return text[i], at[i], n[i], h[i], run[i], np.diff(np.append(i, len(text)))


RUNS = "h long, run long, _id long, _t long, at long, n int, times long"


def run_table(docs: DataFrame, symbols: Callable, window: int, part: int) -> DataFrame:
    """The runs of all texts; docs comes from shared.keyed()."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_blocks(batches):
            values, b = symbols(data, bounds)
            text, at, n, h, run, times = folded(*runs_of(values, b, window, part))
            if len(text):
                ids, ts = rows.column("_id").to_numpy(), rows.column("_t").to_numpy()
                yield pa.record_batch([pa.array(x) for x in (h.view(np.int64), run.view(np.int64), ids[text], ts[text], at, n.astype(np.int32), times)], ["h", "run", "_id", "_t", "at", "n", "times"])

    return docs.select("_id", "_t", "text").mapInArrow(find, RUNS)


def distinct_runs(runs: DataFrame) -> DataFrame:
    """One row for each (h, run): how often it occurs, and one place that has it."""
    return runs.groupBy("h", "run").agg(F.sum("times").alias("c"), F.min(F.struct("_id", "_t", "at", "n")).alias("p")).select("h", "run", "c", "p.*")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Joins to each text its wanted runs: (text, runs array<struct<h, run, c, at, n>>). A list is no longer than its text."""
    lists = wanted.groupBy("_id", "_t").agg(F.collect_list(F.struct("h", "run", "c", "at", "n")).alias("runs"))
    once = docs.select("_id", "_t", "text")
    return once.join(lists.hint("merge"), ["_id", "_t"]).select("text", "runs")


def hits_by_text(runs: DataFrame, found: DataFrame) -> DataFrame:
    """From (h, run, hits) with hits = [from, to, from, to, ...] in windows of a run: all hits of each text."""
    whole = F.array(F.col("at"), F.col("at") + F.col("n") * F.col("times"))
    some = F.transform("hits", lambda x: x.cast("long") + F.col("at"))
    placed = runs.join(found, ["h", "run"]).select("_id", "_t", F.when(F.col("times") > 1, whole).otherwise(some).alias("hits"))
    return placed.groupBy("_id", "_t").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def lists_of(rows: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """(bounds, flat values) of a list column; nulls are empty."""
    col = rows.column(rows.schema.get_field_index(name))
    n = len(col)
    bounds = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
    return bounds - bounds[0], col.values.slice(bounds[0], bounds[-1] - bounds[0])


def covered(hits: np.ndarray, window: int, length: int) -> np.ndarray:
    """Mask of the symbols of a text that a hit window covers."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, hits[0::2], 1)
    np.add.at(step, np.minimum(hits[1::2] + window - 1, length), -1)
    return np.cumsum(step[:-1]) > 0
