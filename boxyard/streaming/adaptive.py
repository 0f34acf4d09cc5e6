"""Adaptive rounds: a model asks for examples of classes, round by round, until it is ready or has had them all.

A round is a decision (detect, or request_examples with class ids) that parse_decisions() read. A request of a class brings its
next example while there is one, so ranks of a class run from 1 without gaps. The rounds of a task end with the first one

- that failed itself (its own status and failure type),
- whose decision cannot be read (model_failure, invalid_context_decision),
- that is `detect` (stop reason model_ready), or
- that brings nothing new (stop reason requested_labels_exhausted).

Rounds after the end, and rounds behind one that has not come yet, do not count. A round that comes twice counts once, the
earlier copy (batch: the first by its answer's usage). Batch and stream give the same rows for the same rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Sums over the rounds of a task.
USAGE = ("prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens")
ROUND = f"task_key string, round_index int, status string, failure_type string, action string, labels array<int>, error string, {', '.join(f'{c} long' for c in USAGE)}, inference_seconds double"
OUTCOME = f"task_key string, status string, failure_type string, stop_reason string, n_rounds int, n_references int, counts map<int,int>, {', '.join(f'{c} long' for c in USAGE)}, inference_seconds double"

SUCCESS, IN_PROGRESS, READY = "success", "in_progress", "ready"
MODEL_READY, EXHAUSTED = "model_ready", "requested_labels_exhausted"
_INVALID = ("model_failure", "invalid_context_decision")


def _usable(rounds: DataFrame) -> DataFrame:
    """Rounds once each, without those behind a missing one."""
    w = W.partitionBy("task_key", "round_index").orderBy(*USAGE)
    d = rounds.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")
    return d.withColumn("_place", F.row_number().over(W.partitionBy("task_key").orderBy("round_index"))).where("_place = round_index + 1").drop("_place")


def _ending(asked: Column, added: Column) -> Column:
    """struct(status, failure_type, stop_reason) of a round that ends its task, else null; asked: it could be read and asks for classes."""
    end = lambda s, f, r: F.struct(F.lit(s).alias("status") if isinstance(s, str) else s.alias("status"), (F.lit(f) if not isinstance(f, Column) else f).cast("string").alias("failure_type"), F.lit(r).cast("string").alias("stop_reason"))
    failed, unread = F.col("status") != SUCCESS, F.col("error").isNotNull() | F.col("action").isNull()
    return F.when(failed, end(F.col("status"), F.col("failure_type"), None)).when(unread, end(*_INVALID, None)).when(F.col("action") == "detect", end(READY, None, MODEL_READY)).when(asked & (added == 0), end(READY, None, EXHAUSTED))


def references_added(rounds: DataFrame, available: DataFrame, most: int) -> DataFrame:
    """(task_key, round_index, category_id, rank) of the examples that each round brings; available: (category_id, n) examples there are.

    A class's request number j brings its example j as long as there is one, so nothing has to be folded: requests are
    numbered, and rounds after the end are cut off.
    """
    return _folded(rounds, available, most)[1]


def _folded(rounds: DataFrame, available: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    r = _usable(rounds)
    good = (F.col("status") == SUCCESS) & F.col("error").isNull() & (F.col("action") == "request_examples")
    asked = r.where(good).select("task_key", "round_index", F.explode(F.array_distinct("labels")).alias("category_id"))
    limit = available.select("category_id", F.least(F.col("n"), F.lit(most)).cast("int").alias("_limit"))
    asked = asked.withColumn("rank", F.row_number().over(W.partitionBy("task_key", "category_id").orderBy("round_index"))).join(limit, "category_id").where(F.col("rank") <= F.col("_limit"))
    added = asked.groupBy("task_key", "round_index").agg(F.count(F.lit(1)).cast("int").alias("_added"))
    r = r.join(added, ["task_key", "round_index"], "left").na.fill(0, ["_added"])
    r = r.withColumn("_end", _ending(good, F.col("_added")))
    ended = F.max(F.col("_end").isNotNull().cast("int")).over(W.partitionBy("task_key").orderBy("round_index").rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_over", F.coalesce(ended, F.lit(0))).where("_over = 0").drop("_over")
    return r, asked.join(r.select("task_key", "round_index"), ["task_key", "round_index"], "left_semi").select("task_key", "round_index", "category_id", "rank")


def fold_rounds(rounds: DataFrame, available: DataFrame, most: int) -> DataFrame:
    """Batch: a row of OUTCOME for each task with a first round: in_progress, ready (the final request may go out) or how it failed."""
    r, added = _folded(rounds, available, most)
    per = r.groupBy("task_key").agg(
        F.max_by("_end", "round_index").alias("e"), F.count(F.lit(1)).cast("int").alias("n_rounds"), F.sum("_added").cast("int").alias("n_references"),
        *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in USAGE], F.sum(F.coalesce("inference_seconds", F.lit(0.0))).alias("inference_seconds"),
    )
    per_class = added.groupBy("task_key", "category_id").agg(F.max("rank").alias("rank")).groupBy("task_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_id", "rank")))).alias("counts"))
    d = per.join(per_class, "task_key", "left")
    counts = F.coalesce("counts", F.expr("cast(map() as map<int,int>)"))
    return d.select("task_key", F.coalesce("e.status", F.lit(IN_PROGRESS)).alias("status"), "e.failure_type", "e.stop_reason", "n_rounds", "n_references", counts.alias("counts"), *USAGE, "inference_seconds")


def _plain(x: tuple) -> tuple:
    """A round as the state keeps it: numbers of Python, class ids as text, None where a value is missing."""
    round_index, status, failure_type, action, labels, error, *numbers = x
    none = lambda v: v is None or v is pd.NA or v != v
    words = [None if none(v) else v for v in (status, failure_type, action)]
    usage = [None if none(v) else int(v) for v in numbers[:-1]]
    return (int(round_index), *words, "" if labels is None else ",".join(str(int(v)) for v in labels), None if none(error) else error, *usage, None if none(numbers[-1]) else float(numbers[-1]))


class _Rounds(StatefulProcessor):
    """Keeps of a task: the rank reached by each class, the rounds that wait for an earlier one, and its sums so far."""

    def __init__(self, limits: dict[int, int], idle_ms: int | None):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ranks = handle.getMapState("ranks", "category_id int", "rank int")
        self.waiting = handle.getListState("waiting", ROUND.removeprefix("task_key string, ").replace("labels array<int>", "labels string"))
        sums = ", ".join(f"{c} long" for c in USAGE)
        self.total = handle.getValueState("total", f"status string, failure_type string, stop_reason string, n_rounds int, n_references int, {sums}, inference_seconds double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [_plain(x) for f in rows for x in f.drop(columns=["task_key"]).itertuples(index=False, name=None)]
        total = list(self.total.get()) if self.total.exists() else [IN_PROGRESS, None, None, 0, 0, *[0] * len(USAGE), 0.0]
        if total[0] != IN_PROGRESS:
            return
        held = {}
        for x in [*(self.waiting.get() if self.waiting.exists() else []), *sorted(new, key=lambda x: tuple(v or 0 for v in x[6:-1]))]:
            if x[0] >= total[3]:
                held.setdefault(x[0], tuple(x))
        before = total[3]
        while total[0] == IN_PROGRESS and total[3] in held:
            self._take(held.pop(total[3]), total)
        self.total.update(tuple(total))
        if held and total[0] == IN_PROGRESS:
            self.waiting.put(list(held.values()))
        elif self.waiting.exists():
            self.waiting.clear()
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if total[0] == IN_PROGRESS:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if total[3] > before:
            yield self._row(key, total)

    def _take(self, x: tuple, total: list) -> None:
        _, status, failure_type, action, labels, error, *usage, seconds = x
        total[3] += 1
        for i, v in enumerate(usage):
            total[5 + i] += int(v or 0)
        total[-1] += float(seconds or 0.0)
        if status != SUCCESS:
            total[:3] = [status, failure_type, None]
        elif error is not None or action is None:
            total[:3] = [*_INVALID, None]
        elif action == "detect":
            total[:3] = [READY, None, MODEL_READY]
        else:
            added = 0
            for c in dict.fromkeys(int(v) for v in labels.split(",") if v):
                rank = self.ranks.getValue((c,))[0] if self.ranks.containsKey((c,)) else 0
                if rank < self.limits.get(c, 0):
                    self.ranks.updateValue((c,), (rank + 1,))
                    added += 1
            total[4] += added
            if not added:
                total[:3] = [READY, None, EXHAUSTED]

    def _row(self, key: tuple, total: list) -> pd.DataFrame:
        counts = {k[0]: v[0] for k, v in self.ranks.iterator()} if self.ranks.exists() else {}
        names = ["status", "failure_type", "stop_reason", "n_rounds", "n_references", *USAGE, "inference_seconds"]
        row = dict(zip(names, total, strict=True)) | {"task_key": key[0], "counts": dict(sorted(counts.items()))}
        return pd.DataFrame([[row[c] for c in _COLUMNS]], columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A task that has been idle is told once more, as stalled; its state goes."""
        total = list(self.total.get())
        total[:3] = ["stalled", None, None]
        yield self._row(key, total)
        for s in (self.total, self.waiting, self.ranks):
            s.clear()

    def close(self) -> None:
        pass


_COLUMNS = [x.strip().split(" ")[0] for x in OUTCOME.replace("map<int,int>", "map").split(",")]


def stream_rounds(rounds: DataFrame, limits: dict[int, int], idle_ms: int | None = None) -> DataFrame:
    """Streaming fold_rounds: in every batch the row as of now of each task that got on.

    limits: class id -> examples there are, at most as many as may be asked for; one entry a class. With idle_ms, a task
    in progress without a new round for so long (processing time) is told as stalled and forgotten. The stream needs the
    RocksDB state store.
    """
    cols = [x.split(" ")[0] for x in ROUND.split(", ")]
    return rounds.select(*cols).groupBy("task_key").transformWithStateInPandas(_Rounds(limits, idle_ms), OUTCOME, "update", "none" if idle_ms is None else "processingTime")


def outcome_table(updates: DataFrame) -> DataFrame:
    """Of the rows that stream_rounds() gave over time the last of each task."""
    rest = _COLUMNS[1:]
    late = F.struct(F.col("n_rounds"), (F.col("status") != IN_PROGRESS).cast("int"))
    return updates.groupBy("task_key").agg(F.max_by(F.struct(*rest), late).alias("r")).select("task_key", "r.*")
