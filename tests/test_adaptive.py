"""Adaptive rounds: batch, stream and a plain loop give the same outcomes."""

import time

import numpy as np
import pytest

from boxyard.streaming import adaptive, streams

LIMITS = {0: 1, 1: 2, 2: 4}


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def rounds():
    r = np.random.default_rng(8)
    out = []
    for task in range(60):
        for i in range(int(r.integers(1, 9))):
            kind = r.choice(["ask", "ask", "ask", "ask", "ask", "detect", "error", "model_failure", "unread", "none"], p=[0.2, 0.2, 0.2, 0.1, 0.1, 0.05, 0.03, 0.03, 0.04, 0.05])
            status = kind if kind in ("error", "model_failure") else "success"
            action = "detect" if kind == "detect" else None if kind in ("unread", "error", "model_failure") else "request_examples"
            labels = [int(c) for c in r.integers(0, 4, int(r.integers(1, 4)))] if action == "request_examples" and kind != "none" else []
            usage = [int(x) if r.random() < 0.9 else None for x in r.integers(1, 500, 4)]
            out.append((f"t{task}", i, status, "timeout" if status == "error" else None, action, labels, "no_action" if kind == "unread" else None, *usage, float(r.integers(1, 40)) / 4 if r.random() < 0.9 else None))
    # rounds behind a missing one wait for ever
    return [x for x in out if not (x[0] in ("t3", "t4") and x[1] == 1)]


def looped(rows):
    tasks = {}
    for x in sorted(rows, key=lambda x: (x[0], x[1])):
        t = tasks.setdefault(x[0], {"status": "in_progress", "failure_type": None, "stop_reason": None, "n": 0, "added": 0, "counts": {}, "usage": [0, 0, 0, 0], "s": 0.0})
        _, i, status, failure, action, labels, error, *usage, seconds = x
        if t["status"] != "in_progress" or i != t["n"]:
            continue
        t["n"] += 1
        t["usage"] = [a + (b or 0) for a, b in zip(t["usage"], usage, strict=True)]
        t["s"] += seconds or 0
        if status != "success":
            t["status"], t["failure_type"] = status, failure
        elif error or not action:
            t["status"], t["failure_type"] = "model_failure", "invalid_context_decision"
        elif action == "detect":
            t["status"], t["stop_reason"] = "ready", "model_ready"
        else:
            new = [c for c in set(labels) if t["counts"].get(c, 0) < LIMITS.get(c, 0)]
            for c in new:
                t["counts"][c] = t["counts"].get(c, 0) + 1
            t["added"] += len(new)
            if not new:
                t["status"], t["stop_reason"] = "ready", "requested_labels_exhausted"
    return {k: (t["status"], t["failure_type"], t["stop_reason"], t["n"], t["added"], t["counts"], *t["usage"], t["s"]) for k, t in tasks.items() if t["n"]}


def told(df):
    return {x["task_key"]: tuple(x)[1:] for x in df.collect()}


def test_batch_equals_a_loop(spark):
    rows = rounds()
    d = spark.createDataFrame(rows + rows[::3], adaptive.ROUND).repartition(5)
    available = spark.createDataFrame([(0, 1), (1, 2), (2, 9)], "category_id int, n int")
    want = looped(rows)
    assert told(adaptive.fold_rounds(d, available, 4)) == want
    assert {x[0] for x in want.values()} == {"in_progress", "ready", "error", "model_failure"} and {x[2] for x in want.values()} == {None, "model_ready", "requested_labels_exhausted"}
    added = adaptive.references_added(d, available, 4).collect()
    assert len(added) == sum(x[4] for x in want.values())
    ranks = {}
    for x in sorted(added, key=lambda x: x["round_index"]):
        ranks.setdefault((x["task_key"], x["category_id"]), []).append(x["rank"])
    assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())
    assert adaptive.fold_rounds(d.where("1 = 0"), available, 4).count() == 0


def test_stream_equals_batch_whatever_comes_late(spark, tmp_path, rocksdb):
    rows = rounds()
    order = np.random.default_rng(2).permutation(len(rows))
    for part in np.array_split(order, 5):
        some = [rows[i] for i in part]
        spark.createDataFrame(some + some[:3], adaptive.ROUND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = adaptive.stream_rounds(spark.readStream.schema(adaptive.ROUND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), LIMITS)
    q = s.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    updates = spark.read.schema(s.schema).parquet(str(tmp_path / "out"))
    assert told(adaptive.outcome_table(updates)) == looped(rows)
    # what a task has used never shrinks from batch to batch
    assert updates.count() > len(looped(rows))


def test_an_idle_task_is_told_and_forgotten(spark, tmp_path, rocksdb):
    rows = [("a", 0, "success", None, "request_examples", [1], None, 1, 1, 1, 1, 1.0), ("b", 0, "success", None, "detect", [], None, 1, 1, 1, 1, 1.0)]
    spark.createDataFrame(rows, adaptive.ROUND).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = adaptive.stream_rounds(spark.readStream.schema(adaptive.ROUND).parquet(str(tmp_path / "in")), LIMITS, idle_ms=500)
    q = s.writeStream.outputMode("update").format("memory").queryName("idle_tasks").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("idle_tasks").where("status = 'stalled'").count():
            time.sleep(1)
    finally:
        q.stop()
    got = {(x["task_key"], x["status"]) for x in spark.table("idle_tasks").collect()}
    assert got == {("a", "in_progress"), ("a", "stalled"), ("b", "ready")}


def test_counts_by_mode_after_every_batch(spark, tmp_path, rocksdb):
    """Each batch's version equals a count over all records so far, and only two versions stay."""
    r = np.random.default_rng(5)
    rows = [(f"t{int(r.integers(0, 40))}", str(r.choice(["a", "b"])), str(r.choice(["error", "running", "success", "model_failure"], p=[0.4, 0.3, 0.2, 0.1])), f"2024-01-01 00:{int(r.integers(0, 60)):02}:00", i) for i in range(200)]
    schema = "task_key string, mode string, status string, completed_at string, event_id long"
    seen = []
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streams.stream_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
        got = {(x["mode"], x["status"]): x["n"] for x in streams.counts_table(spark, str(tmp_path / "out")).collect()}
        last = streams.latest_state(spark.createDataFrame(rows[: 50 * k + 50], schema)).groupBy("mode", "status").count().collect()
        assert got == {(x["mode"], x["status"]): x["count"] for x in last}
        seen.append(sorted(x.name for x in (tmp_path / "out").iterdir()))
    assert all(len(x) == 2 for x in seen) and seen[-1] != seen[0]
