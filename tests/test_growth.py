"""Steps that cost too much on larger tables: what their plans may not hold, and that their results stay."""

import numpy as np
from pyspark.sql import functions as F

from boxyard.functions.geometry import AREAS
from boxyard.operators import coco, detections, matching, stats, tasks, validate
from boxyard.streaming import streams


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_counts_need_no_state_in_python(spark, tmp_path):
    """The default state store is enough, and a batch that brings a task again moves it from one count to another."""
    schema = "task_key string, mode string, status string, completed_at string, event_id long"
    batches = [[("a", "m", "running", "2024-01-01 00:01:00", 1), ("b", "m", None, None, None)], [("a", "m", "success", "2024-01-01 00:02:00", 2), ("b", "n", "error", "2024-01-01 00:00:30", 3)], [("a", "m", "success", "2024-01-01 00:01:30", 4), ("a", "m", "error", "2024-01-01 00:09:00", 5)]]
    told = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        told.append({(x["mode"], x["status"], x["n"]) for x in streams.counts_table(spark, str(tmp_path / "out")).collect()})
    assert told == [{("m", "running", 1), ("m", None, 1)}, {("m", "success", 1), ("n", "error", 1)}, {("m", "success", 1), ("n", "error", 1)}]


def boxes(spark, rows, kind):
    return spark.createDataFrame(rows, f"dataset string, {kind}, image_id long, category_id int, x double, y double, w double, h double")


def test_objects_are_not_copied_for_each_mode(spark):
    """One pass over objects and detections, without joins of large sides; rows with null keys meet nothing."""
    b = (0.0, 0.0, 10.0, 10.0)
    g = boxes(spark, [("d", 1, 1, 0, *b), ("d", 2, 1, 1, *b), ("d", 3, 2, None, *b), ("e", 4, 3, 0, *b)], "ann_id long")
    p = boxes(spark, [("d", "m", 1, 1, 0, *b), ("d", "m", 2, 1, 0, *b), ("d", "n", 1, 2, None, *b), ("d", "m", 1, 7, 2, *b)], "mode string, det_ord long")
    d = matching.image_f1(g, p)
    got = {(x["mode"], x["image_id"], x["category_id"], x["n_gt"], x["n_pred"], x["n_matched"]) for x in d.collect()}
    assert got == {("m", 1, 0, 1, 2, 1), ("n", 1, 0, 1, 0, 0), ("m", 1, 1, 1, 0, 0), ("n", 1, 1, 1, 0, 0), ("m", 2, None, 1, 0, 0), ("n", 2, None, 1, 0, 0), ("n", 2, None, 0, 1, 0), ("m", 7, 2, 0, 1, 0)}
    assert "SortMergeJoin" not in plan_of(d)
    taken = matching.greedy_match(matching.object_candidates(g, p, 0.5), ["dataset", "mode", "image_id", "category_id"])
    assert [(x["mode"], x["l"], x["r"]) for x in taken.collect()] == [("m", 1, 2)]
    assert plan_of(taken).count("Exchange hashpartitioning") == 1


def test_a_label_is_looked_up_once(spark):
    d = spark.createDataFrame([("d", "m", 1, [([0.0, 0.0, 500.0, 500.0], " A  b"), ([0.0, 500.0, 500.0, -1.0], "a b"), ([1.0], "a b"), ([0.0] * 4, "c")])], "dataset string, mode string, image_id long, dets array<struct<bbox:array<double>,label:string>>")
    images = spark.createDataFrame([("d", 1, 100, 200)], "dataset string, image_id long, width int, height int")
    n = detections.normalize_detections(d, images, spark.createDataFrame([("d", 5, "a b")], "dataset string, category_id int, name string"))
    x = n.collect()[0]
    assert [(q["category_id"], q["x"], q["y"], q["w"], q["h"]) for q in x["predictions"]] == [(5, 0.0, 0.0, 50.0, 100.0)]
    assert (x["parsed_detections"], x["invalid_boxes"], x["duplicate_boxes"], x["clamped_boxes"], x["reordered_axes"], x["ignored_labels"]) == (4, 1, 1, 1, 1, ["c"])
    assert n._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2  # the label's, and the class names'


def test_fingerprints_deal_no_tasks(spark):
    """Tasks that carry their image's content meet no table but the hashes of classes; records are dealt once for conflicts."""
    images = spark.createDataFrame([("d", 1, "1.jpg"), ("d", 2, "2.jpg")], "dataset string, image_id long, file_name string")
    arms = spark.createDataFrame([("s", "single"), ("m", "multi")], "mode string, formulation string")
    classes = spark.createDataFrame([("d", 7), ("d", 8)], "dataset string, category_id int")
    payloads = spark.createDataFrame([("d", 7, 2, 1, "P")], "dataset string, category_id int, image_id long, part int, payload string")
    make = lambda *carried: tasks.full_fingerprint(tasks.task_matrix(images, arms, classes, carried), payloads, images, "Find.", {"a": "1"})
    now = make("file_name")
    key = lambda d: {(x["task_key"], x["fingerprint"]) for x in d.collect()}
    assert key(now) == key(make()) and now.count() == 6
    assert plan_of(make("file_name")).count("SortMergeJoin") < plan_of(make()).count("SortMergeJoin")
    records = now.select("task_key", "fingerprint", F.lit("success").alias("status"))
    other = records.withColumn("fingerprint", F.when(F.col("task_key").endswith("all"), "other").otherwise(F.col("fingerprint")))
    found = tasks.conflicts(now, records.unionByName(other).unionByName(other))
    assert sorted((x["task_key"], x["recorded"]) for x in found.collect()) == [("m__image_1__class_all", "other"), ("m__image_2__class_all", "other")]
    assert not [x for x in plan_of(found).splitlines() if "Exchange hashpartitioning" in x and "task_key" in x and "fingerprint" in x]


def test_annotations_of_a_snapshot_are_hashed_once(spark, tmp_path):
    """What the images' hashes and the comparison of annotations read is derived once."""
    i = spark.createDataFrame([("d", 1, "1.jpg")], "dataset string, image_id long, file_name string")
    seen = spark.sparkContext.accumulator(0)

    def counted(c):
        def pass_on(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return spark.createDataFrame([("d", 1, 5, c)], "dataset string, image_id long, ann_id long, category_id int").mapInArrow(pass_on, "dataset string, image_id long, ann_id long, category_id int")

    got = validate.snapshot_changes((i, counted(1)), (i, counted(2))).collect()
    assert {(x["level"], x["image_id"], x["ann_id"], x["change"]) for x in got} == {("dataset", None, None, "changed"), ("image", 1, None, "changed"), ("annotation", 1, 5, "changed")}
    assert seen.value == 2


def test_detections_are_judged_in_one_grouping(spark):
    """One shuffle and no join from boxes to hits; objects without detections are counted once, null classes meet nothing, ranks follow score and list."""
    b, far = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 10.0, 10.0)
    g = boxes(spark, [("d", 1, 1, 0, *b), ("d", 2, 1, 0, *b), ("d", 3, 2, None, *b), ("d", 4, 3, 0, *far)], "ann_id long")
    rows = [("d", "m", 1, 0.5, 1, 0, *b), ("d", "m", 2, 0.9, 1, 0, *far), ("d", "m", 3, 0.9, 1, 0, *b), ("d", "m", 4, 0.1, 1, 0, *b), ("d", "n", 1, 0.5, 1, 0, 0.0, 0.0, 10.0, 6.0), ("d", "n", 2, 0.5, 2, None, *b)]
    p = spark.createDataFrame(rows, "dataset string, mode string, det_ord int, score double, image_id long, category_id int, x double, y double, w double, h double")
    d = coco.matched(g, p, [0.5, 0.75], ("all",), 3)
    got = {(x["mode"], x["image_id"], x["category_id"], x["det_ord"]): (x["rank"], x["tp"], x["ignored"]) for x in coco.judged(g, p, [0.5, 0.75], ("all",), 3).collect()}
    assert got == {("m", 1, 0, 2): (1, 0, 0), ("m", 1, 0, 3): (2, 3, 0), ("m", 1, 0, 1): (3, 3, 0), ("n", 1, 0, 1): (1, 1, 0), ("n", 2, None, 2): (1, 0, 0)}
    assert sum(x["npig_all"] for x in d.collect()) == 4
    assert plan_of(d).count("Exchange") == 1 and "Join" not in plan_of(d)


def test_repeats_meet_in_one_grouping(spark, monkeypatch):
    """Answers and boxes are dealt once; boxes without an answer or a class do not match, and what is left of images is few rows."""
    b = (0.0, 0.0, 10.0, 10.0)
    kept = []
    monkeypatch.setattr(stats, "keep", lambda d, name: kept.append(d) or d)
    a = spark.createDataFrame([("d", i, m, t) for i in (1, 2, 3) for m, t in (("x", "same"), ("y", "same" if i < 3 else None))], "dataset string, image_id long, mode string, raw_response string")
    rows = [("d", "x", 1, 1, 0, *b), ("d", "y", 1, 1, 0, *b), ("d", "x", 1, 2, 0, *b), ("d", "y", 1, 2, None, *b), ("d", "z", 1, 2, 0, *b)]
    p = spark.createDataFrame([(*r, 0.5) for r in rows], "dataset string, mode string, det_ord int, image_id long, category_id int, x double, y double, w double, h double, score double")
    x = stats.repeat_agreement(p, a).collect()[0]
    assert (x["n_images"], x["n_repeats"], x["n_pairs"], x["n_matches"], x["mean_iou"]) == (3, 2, 3, 1, 1.0)
    assert [round(x[c], 6) for c in ("same_answer", "same_content", "same_count", "same_classes", "mean_f1")] == [0.666667, 0.666667, 1.0, 0.666667, 0.666667]
    assert plan_of(kept[0]).count("Exchange") == 2 and "Join" not in plan_of(kept[0])


def test_judging_follows_the_turns(spark):
    """Crowded groups with ties, crowds, area ranges and many modes against a fold by hand, whatever the batches; no fold for each threshold in the plan."""
    r = np.random.default_rng(11)
    g, p = [], []
    for image in range(30):
        for c in (0, 1):
            g += [("d", 1000 * image + 10 * k + c, image, c, *map(float, r.integers(0, 12, 2)), float(r.integers(20, 60)), float(r.integers(20, 60)), int(r.random() < 0.15)) for k in range(int(r.integers(0, 7)))]
            p += [("d", "ab"[k % 2], 100 * c + k, float(r.integers(0, 4)), image, c, *map(float, r.integers(0, 12, 2)), float(r.integers(20, 60)), float(r.integers(20, 60))) for k in range(int(r.integers(0, 14)))]
    gt = spark.createDataFrame(g, "dataset string, ann_id long, image_id long, category_id int, x double, y double, w double, h double, iscrowd int")
    pred = spark.createDataFrame(p, "dataset string, mode string, det_ord int, score double, image_id long, category_id int, x double, y double, w double, h double")
    areas, most = ("all", "small", "medium"), 5

    def iou(a, b, crowd):
        inter = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        union = a[2] * a[3] if crowd else a[2] * a[3] + b[2] * b[3] - inter
        return inter / union if union > 0 else 0.0

    want = {}
    for key in {(x[1], x[4], x[5]) for x in p}:
        objects = [x for x in g if x[2:4] == key[1:]]
        dets = sorted((x for x in p if (x[1], x[4], x[5]) == key), key=lambda x: (-x[3], x[2]))[:most]
        bits = {x[2]: [0, 0] for x in dets}
        for cell, (t, a) in enumerate((t, a) for t in coco.IOU_THRESHOLDS for a in areas):
            lo, hi = AREAS[a]
            out = lambda w, h: w * h < lo or w * h > hi  # noqa: E731, B023
            free = set(range(len(objects)))
            for x in dets:
                near = [(o[8] == 1 or out(o[6], o[7]), -v, -o[1], k) for k, o in enumerate(objects) if k in free and (v := iou(x[6:], o[4:8], o[8] == 1)) >= t]
                if near:
                    ignored, _, _, k = min(near)
                    bits[x[2]][ignored] |= 1 << cell
                    free -= {k} if objects[k][8] == 0 else set()
                elif out(x[8], x[9]):
                    bits[x[2]][1] |= 1 << cell
        want |= {(*key, o): (n, *b) for n, (o, b) in enumerate(bits.items(), 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        d = coco.matched(gt, pred, coco.IOU_THRESHOLDS, areas, most)
        got = {(x["mode"], x["image_id"], x["category_id"], x["det_ord"]): (x["rank"], x["tp"], x["ignored"]) for x in coco.judged(gt, pred, coco.IOU_THRESHOLDS, areas, most).collect()}
        npig = d.agg(F.sum("npig_all")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and npig == sum(x[8] == 0 for x in g)
    assert "aggregate(" not in plan_of(d)
