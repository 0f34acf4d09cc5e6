"""Hand values of matching, scoring, noise, routing, parsing and checks."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxyard.functions import geometry, labels
from boxyard.operators import coco, detections, matching, merge, parsing, references, runs, selection, stats, tasks, validate
from boxyard.sources import files
from boxyard.streaming import streams

GT = "dataset string, image_id long, category_id int, ann_id long, x double, y double, w double, h double"
PRED = "dataset string, mode string, image_id long, category_id int, x double, y double, w double, h double, score double, det_ord int"


def one(df):
    return df.collect()[0].asDict()


def test_iou_and_agreement(spark):
    p = spark.createDataFrame(
        [("d", "a", 1, 1, 0.0, 0.0, 10.0, 10.0, 1.0, 1), ("d", "a", 1, 2, 20.0, 20.0, 10.0, 10.0, 1.0, 2), ("d", "b", 1, 1, 1.0, 1.0, 10.0, 10.0, 1.0, 1), ("d", "b", 1, 3, 20.0, 20.0, 10.0, 10.0, 1.0, 2)], PRED,
    )
    images = spark.createDataFrame([("d", 1), ("d", 2)], "dataset string, image_id long")
    r = {x["image_id"]: x for x in matching.detection_agreement(p, images, [("a", "b")]).collect()}
    assert r[1]["n_matched"] == 1 and r[1]["f1"] == 0.5 and abs(r[1]["sum_iou"] - 81 / 119) < 1e-12
    assert r[2]["f1"] == 1.0


def test_greedy_is_one_to_one(spark):
    g = spark.createDataFrame([("d", 1, 1, 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 1, 2, 0.0, 0.0, 10.0, 10.0)], GT)
    p = spark.createDataFrame([("d", "m", 1, 1, 0.0, 0.0, 10.0, 10.0, 1.0, 1)], PRED)
    assert one(matching.known_object_recall(g, p))["n_found50"] == 1


def test_known_object_recall(spark):
    g = spark.createDataFrame([("d", 1, 1, 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 1, 2, 20.0, 20.0, 10.0, 10.0)], GT)
    p = spark.createDataFrame([("d", "m", 1, 1, 0.0, 0.0, 10.0, 10.0, 1.0, 1), ("d", "m", 1, 1, 100.0, 100.0, 10.0, 10.0, 1.0, 2)], PRED)
    r = one(matching.recall_summary(matching.known_object_recall(g, p)))
    assert r["micro_recall50"] == 0.5 and r["macro_recall50"] == 0.5


def test_perfect_and_empty_scores(spark):
    g = spark.createDataFrame([("d", 1, 1, 1, 10.0, 10.0, 20.0, 20.0), ("d", 1, 2, 2, 50.0, 50.0, 10.0, 10.0)], GT)
    p = g.select("dataset", F.lit("m").alias("mode"), "image_id", "category_id", "x", "y", "w", "h", F.lit(1.0).alias("score"), F.lit(1).alias("det_ord"))
    for r in coco.coco_score_by_category(g, p).collect():
        assert abs(r["ap"] - 100) < 1e-9 and abs(r["ap50"] - 100) < 1e-9
    far = p.withColumn("x", F.col("x") + 500)
    assert all(r["ap"] == 0 for r in coco.coco_score_by_category(g, far).collect())


def test_crowd_takes_detections_without_counting_them(spark):
    g = spark.createDataFrame([("d", 1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0), ("d", 1, 1, 2, 100.0, 100.0, 100.0, 100.0, 1)], GT + ", iscrowd int")
    p = spark.createDataFrame([("d", "m", 1, 1, 110.0, 110.0, 10.0, 10.0, 0.9, 1), ("d", "m", 1, 1, 130.0, 130.0, 10.0, 10.0, 0.8, 2), ("d", "m", 1, 1, 0.0, 0.0, 10.0, 10.0, 0.7, 3)], PRED)
    r = one(coco.coco_score_by_category(g, p))
    assert abs(r["ap"] - 100) < 1e-9 and r["n_objects"] == 1


def test_repeat_noise(spark):
    rows = spark.createDataFrame([("m", v) for v in (10.0, 10.5, 9.5, 10.2, 9.8)], "mode string, v double")
    r = one(stats.repeat_noise(rows, ["mode"], "v"))
    sd = np.std([10.0, 10.5, 9.5, 10.2, 9.8], ddof=1)
    assert abs(r["mean"] - 10) < 1e-12 and abs(r["range"] - 1) < 1e-12 and abs(r["tie_threshold"] - max(1.0, 1.96 * 2**0.5 * sd)) < 1e-12
    assert stats.repeat_noise(rows.limit(2), ["mode"], "v").count() == 0


def test_repeat_interval_without_spread(spark):
    rows = [("d", f"b{b}", r, 10.0 + r + o, 0.0) for r in (1, 2, 3) for b, o in ((1, 0), (2, 2), (5, 5))]
    r = {x["mode"]: x for x in stats.repeat_ci(spark.createDataFrame(rows, "dataset string, mode string, repeat int, map5095 double, map50 double"), "b1").collect()}
    assert (r["b5"]["mean"], r["b5"]["low"], r["b5"]["high"]) == (5, 5, 5)


def test_cluster_effect(spark):
    rows = spark.createDataFrame([("one", 1, 4.0), ("one", 0, 1.0), ("two", 1, 6.0), ("two", 0, 3.0)], "dataset string, flag int, y double")
    a, b = (one(stats.cluster_bootstrap(rows, "flag", "y", 50, 3)) for _ in range(2))
    assert a["estimate"] == 3.0 and a == b


def test_count_ladder(spark):
    steps = [(0, 20.0, 40.0), (1, 23.0, 45.0), (2, 24.0, 46.0), (5, 26.0, 50.0), (10, 27.0, 52.0)]
    d = spark.createDataFrame([("d", c, r, q) for c, r, q in steps], "dataset string, count int, recall double, recall50 double")
    r = one(selection.count_route(d, [0, 1, 2, 5, 10], 2.0))
    assert r["selected"] == 5 and r["accepted"] == [True, False, True, False]
    assert selection.count_route(d.where("count <> 2"), [0, 1, 2, 5, 10], 2.0).count() == 0
    assert selection.missing_counts(d.where("count <> 2"), [0, 1, 2, 5, 10]).count() == 1


def test_binary_route(spark):
    def route(r, r50):
        d = spark.createDataFrame([("d", "names", 40.0, 60.0), ("d", "refs", r, r50)], "dataset string, mode string, recall double, recall50 double")
        return one(selection.binary_route(d, "names", "refs", 2.0))["selected_mode"]

    assert route(43.0, 61.0) == "refs" and route(43.0, 59.0) == "names" and route(41.0, 61.0) == "names"


def test_votes(spark):
    v = spark.createDataFrame([("a", "x")] * 3 + [("b", "x"), ("b", "x"), ("b", "refs"), ("c", "x"), ("c", "refs")], "dataset string, route string")
    r = {x["dataset"]: (x["route"], x["stable"]) for x in selection.majority_route(v, "refs").collect()}
    assert r == {"a": ("x", True), "b": ("x", False), "c": ("refs", False)}


def test_efficiency_tie(spark):
    d = spark.createDataFrame([("g", "a", 30.0, 6), ("g", "b", 29.2, 1), ("g", "c", 28.9, 1)], "g string, mode string, map5095 double, calls int")
    assert one(selection.efficient_best(d, 1.0, ["g"], costs=("calls",)))["mode"] == "b"


def test_cost(spark):
    c = one(spark.range(1).select(runs.token_cost(F.lit(100), F.lit(40), F.lit(20)).alias("c"), runs.token_cost(F.lit(1), F.lit(2), F.lit(0)).alias("bad")))
    assert abs(c["c"] - (60 * 2 + 40 * 0.25 + 20 * 6) / 1e6) < 1e-15 and c["bad"] is None


def test_normalized_detections(spark):
    parsed = spark.createDataFrame(
        [("d", "m", 1, [([1100.0, 900.0, -100.0, 100.0], "cat"), ([1100.0, 900.0, -100.0, 100.0], " CAT"), ([0.0, 0.0, 10.0, 10.0], "caterpillar"), ([5.0, 5.0, 5.0, 9.0], "cat")])],
        "dataset string, mode string, image_id long, dets " + detections.DETECTIONS,
    )
    images = spark.createDataFrame([("d", 1, 200, 100)], "dataset string, image_id long, width int, height int")
    cats = spark.createDataFrame([("d", 3, "Cat")], "dataset string, category_id int, name string")
    r = one(detections.normalize_detections(parsed, images, cats))
    assert [(p["x"], p["y"], p["w"], p["h"]) for p in r["predictions"]] == [(0.0, 10.0, 200.0, 80.0)]
    assert (r["duplicate_boxes"], r["invalid_boxes"], r["clamped_boxes"], r["reordered_axes"], r["ignored_labels"]) == (1, 1, 2, 4, ["caterpillar"])


@pytest.mark.parametrize(
    ("text", "status", "boxes"),
    [
        ('<think>[0]</think>```json\n[{"bbox_2d":[1,2,3,4],"label":"a"}]\n```', "ok", [[1, 2, 3, 4]]), ('{"bbox_2d":[1,2,3,4],"label":"a"}', "ok", [[1, 2, 3, 4]]), ("[]", "ok", []),
        ("{'objects': [{'box_2d': [1, 2, 3, '4'], 'class': 'a'}]}", "ok", [[1, 2, 3, 4]]), ('[{"bbox_2d":[1,2,3,4],"label":"a"},{"bbox_2d":[5,6,7,8],"label":"b"},{"bbox_2d":[9', "salvaged", [[1, 2, 3, 4], [5, 6, 7, 8]]),
        ('[{"bbox_2d":[1,2,3,4],"label":"a"},]', "ok", [[1, 2, 3, 4]]), ("there is nothing", "invalid_response", []), (None, "invalid_response", []), ('[{"bbox_2d":[true,2,3,4],"label":"a"}]', "ok", [[None, 2, 3, 4]]),
    ],
)
def test_answers(spark, text, status, boxes):
    r = one(parsing.parse_responses(spark.createDataFrame([(text,)], "raw_response string")))
    assert r["status"] == status and [list(d["bbox"]) for d in r["dets"]] == boxes
    assert parsing.salvage(text)[0] == status


@pytest.mark.parametrize(
    ("text", "status", "n"),
    [
        ("it's [see {below}] {'boxes': [{'bbox': (1, 2, 3, 4), 'name': \"it's\",},]}", "ok", 1), ('note [1 {"bounding_box":[1,2,3,4],"class_label":"a"} {"bounding_box":[1,2,3,4],"class_label":"a"} x', "salvaged", 1),
        ('```json\n{"a":1}\n``` then [{"bbox":[1,2,3,4],"label":"a"}]', "invalid_response", 0), ('{"x": [{"bbox":[1,2,3,4],"label":"a"}]}', "invalid_response", 0), ("{'bbox': [1,2,3,4], 'label': None} and more", "ok", 0), ('[{"bbox":[1,2,3,4],"label":"a"},]', "ok", 1),
    ],
)
def test_answers_in_odd_notations(text, status, n):
    got = parsing.salvage(text)
    assert got[0] == status and len(got[1]) == n


def test_long_hostile_answers_take_linear_time():
    for text in ("[" * 200_000, "[{" * 100_000, '[{"a' * 60_000, "{'" * 100_000, '[{"bbox_2d":[1,2,3,4],"label":"a"},' * 20_000, "[1," * 100_000):
        started = time.process_time()
        parsing.salvage(text)
        assert time.process_time() - started < 20


def test_decisions(spark):
    cats = spark.createDataFrame([("d", 3, "Cat"), ("d", 4, "dog")], "dataset string, category_id int, name string")
    texts = ['{"action":"More","labels":[" CAT ","cat","Dog"]}', '{"action":"detect","labels":["cat"]}', '{"action":"stop","confidence":"0.5"} {"action":"more"}', '{"action":"more","labels":[1]}', '{"action":"request more","labels":[]}', '{"action":"x"}', '{"action":"ready","confidence":2}', "{bad} {\"action\": \"ready\", \"more\": {}}", None]
    d = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "i int, dataset string, raw_response string")
    r = {x["i"]: (x["action"], x["confidence"], x["labels"], x["error"]) for x in parsing.parse_decisions(d, cats).collect()}
    assert r[0] == ("request_examples", None, [3, 4], None) and r[1][3] == "labels_of_detect" and r[2] == ("detect", 0.5, [], None)
    assert [r[i][3] for i in range(3, 9)] == ["labels", "no_label", "no_action", "confidence", None, "no_action"]


def test_provider_failures_are_told_narrowly(spark):
    said = ["used 1500 tokens", "capital", "401 unauthorized", "content blocked for safety", "<503> upstream", "Error code: 502", "APIConnectionError", "input image data may contain inappropriate content"]
    d = spark.createDataFrame([(i, "error", 1, t) for i, t in enumerate(said)], "i int, status string, n_attempts int, error string")
    r = {x["i"]: x["failure_type"] for x in runs.classify_failure(d).collect()}
    assert [r[i] for i in range(8)] == [None] * 4 + ["provider_request_failure"] * 3 + ["provider_content_rejection"]
    coded = d.withColumn("status_code", F.when(F.col("i") == 0, 409).when(F.col("i") == 4, 400))
    r = {x["i"]: x["failure_type"] for x in runs.classify_failure(coded).collect()}
    assert r[0] == "provider_request_failure" and r[4] is None


def test_repeats_without_a_critical_value_are_an_error(spark):
    rows = [("d", m, r, 10.0 + r) for r in range(4) for m in ("a", "b")]
    with pytest.raises(Exception, match="no critical value"):
        stats.repeat_ci(spark.createDataFrame(rows, "dataset string, mode string, repeat int, map5095 double"), "a").collect()


def test_same_answers_of_repeats(spark):
    p = spark.createDataFrame([("d", m, i, 1, 0.0, 0.0, 1.0, 1.0, 1.0, 1) for m in "ab" for i in (1, 2, 3, 4)], PRED)
    a = spark.createDataFrame([("d", "a", 1, "x"), ("d", "b", 1, "x"), ("d", "a", 2, "x"), ("d", "b", 2, "y"), ("d", "a", 3, "x"), ("d", "a", 4, None), ("d", "b", 4, "")], "dataset string, mode string, image_id long, raw_response string")
    r = one(stats.repeatability(p, answers=a))
    assert (r["n_images"], r["same_content"], r["same_answer"]) == (4, 1.0, 0.25)


def test_finished_runs_tell_what_failed(spark):
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(1, "a", "m", "error", None), (2, "a", "m", "model_failure", "provider_request_failure"), (3, "b", "m", "success", None)]
    records = spark.createDataFrame([(*r, at, 1.0, 1, 0, 1) for r in rows], "event_id long, task_key string, mode string, status string, failure_type string, completed_at timestamp, inference_seconds double, prompt_tokens long, cached_tokens long, completion_tokens long")
    tasks = spark.createDataFrame([("a", "m"), ("b", "m")], "task_key string, mode string")
    scores = spark.createDataFrame([("m", 5.0)], "mode string, map5095 double")
    r = one(runs.finalize_runs(tasks, records, scores, spark.createDataFrame([("m",)] * 3, "mode string")))
    assert (r["complete"], r["map5095"], r["calls_per_task"], r["n_predictions"], r["failure_types"]) == (True, 5.0, 1.5, 3, {"provider_request_failure": 1})


def test_sections_are_headed_by_lines_of_their_own(spark):
    text = "about # Object Classes here\n# Object Classes\n\n## A\nof a\n### not one\n## B\nof b"
    d = spark.createDataFrame([(1, text), (2, "no heading ## A\n## B\n"), (3, "# Object Classes\n## A\nx\n"), (4, None)], "i int, text string")
    r = {x["i"]: x["rotated"] for x in parsing.rotate_sections(d).collect()}
    assert r[1] == "about # Object Classes here\n# Object Classes\n\n## A\nof b\n## B\nof a\n### not one\n" and r[2] is r[3] is r[4] is None


def test_wire_coordinates(spark):
    b = one(spark.range(1).select(geometry.xywh_to_norm1000(*(F.lit(v) for v in (160.0, 48.0, 320.0, 384.0, 640, 480))).alias("b")))["b"]
    assert tuple(b) == (250, 100, 750, 900)
    assert one(spark.range(1).select(geometry.xywh_to_norm1000(*(F.lit(v) for v in (1.0, 1.0, 0.0, 2.0, 10, 10))).alias("b")))["b"] is None


def test_concept_letters(spark):
    d = {r["id"]: r["x"] for r in spark.range(800).select("id", labels.concept_letters(F.col("id")).alias("x")).collect()}
    assert [d[k] for k in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_dataset_rules(spark):
    i = spark.createDataFrame([("d", 7, 20, 10)], "dataset string, image_id long, width int, height int")
    c = spark.createDataFrame([("d", 3, "a")], "dataset string, category_id int, name string")

    def broken(box):
        return {r["rule"] for r in validate.validate_dataset(i, spark.createDataFrame([("d", 7, 3, 1, *box)], GT), c).collect()}

    assert broken((1.0, 2.0, 3.0, 4.0)) == set() and broken((18.0, 2.0, 3.0, 4.0)) == {"outside"} and broken((1.0, 2.0, 0.0, 4.0)) == set() and broken((1.0, 2.0, -1.0, 4.0)) == {"negative_box"}


def test_nested_references(spark):
    a = spark.createDataFrame([("d", 1, k, k, k / 100, f"f{k}") for k in range(1, 30)], "dataset string, category_id int, ann_id long, image_id long, rel_area double, file_name string")
    five = {(r["ann_id"], r["rank"]) for r in references.seeded_random_references(a, 5, 1).collect()}
    ten = {(r["ann_id"], r["rank"]) for r in references.seeded_random_references(a, 10, 1).collect()}
    assert five < ten and (29, 1) in five


def test_farthest_points_and_cover():
    assert references.farthest_points(np.array([[0.0], [1.0], [10.0], [5.0]]), 0, 3) == [0, 2, 3]
    pdf = pd.DataFrame({"image_id": [1, 1, 2, 3], "category_id": [0, 1, 2, 0], "n": [1, 1, 1, 9]})
    assert references._greedy_cover(pdf, 2) == [1, 2]


def test_diverse_reference_images_come_first(spark):
    f = spark.createDataFrame([("a", 1, 1, [0.0]), ("a", 2, 1, [9.0]), ("a", 3, 2, [1.0]), ("a", 4, 2, [2.0])], "label string, item_id long, image_id long, vector array<double>")
    r = [x["item_id"] for x in references.diverse_references(f, 3, distinct="image_id").orderBy("rank").collect()]
    assert r == [1, 3, 2]


def test_merges_refuse_overlap(spark):
    a = spark.createDataFrame([("d", "m", 1.0)], "dataset string, mode string, map5095 double")
    with pytest.raises(merge.ContractError):
        merge.merge_runs(a, a)


def test_files_round_trip(spark, tmp_path):

    d = tmp_path / "coco" / "ds" / "train"
    d.mkdir(parents=True)
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "cat"}]}
    (d / "_annotations.coco.json").write_text(json.dumps(doc, indent=2))
    i, a, c = files.read_coco(spark, str(tmp_path / "coco"))
    assert one(a)["w"] == 3.0 and one(i)["dataset"] == "ds" and one(c)["cat_ord"] == 0
    back = json.loads(one(files.to_coco_document(i, a, c))["document"])
    assert back["images"] == doc["images"] and back["annotations"][0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    (d / "more_annotations.coco.json").write_text(json.dumps(doc, indent=2))
    with pytest.raises(merge.ContractError):
        files.read_coco(spark, str(tmp_path / "coco"))
    p = tmp_path / "pred" / "ds"
    p.mkdir(parents=True)
    (p / "names.json").write_text(json.dumps([{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}] * 2, indent=2))
    assert [r["det_ord"] for r in files.read_predictions(spark, str(tmp_path / "pred")).collect()] == [1, 2]
    r = tmp_path / "records"
    r.mkdir()
    (r / "a.json").write_text(json.dumps({"task_key": "t", "status": "success"}))
    (r / "b.json").write_text("not json")
    good, bad = files.read_records(spark, str(r))
    assert good.count() == 1 and bad.count() == 1
    s = tmp_path / "runs" / "ds"
    s.mkdir(parents=True)
    (s / "comparison_summary.json").write_text(json.dumps({"rows": [{"mode": "a", "map5095": 1.0, "complete": True}, {"mode": "b", "complete": False}]}))
    assert files.read_run_rows(spark, str(tmp_path / "runs/*/comparison_summary.json"), strict=False).count() == 1
    with pytest.raises(merge.ContractError):
        files.read_run_rows(spark, str(tmp_path / "runs/*/comparison_summary.json"))
    done = spark.createDataFrame([("a", True)], "mode string, complete boolean")
    files.write_results(a.withColumn("mode", F.lit("a")), str(tmp_path / "out"), done)
    assert (tmp_path / "out" / "_SUCCESS").exists()
    with pytest.raises(merge.ContractError):
        files.write_results(a.withColumn("mode", F.lit("a")), str(tmp_path / "out2"), done.withColumn("complete", F.lit(False)))
    inv = files.inventory(spark, str(tmp_path / "coco"))
    assert {x["path"] for x in inv.collect()} == {"train/more_annotations.coco.json"}


def test_turn_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "a" * 300), (1, 1, "b" * 300), (1, 2, "c"), (2, 0, "short")], "conv_id long, turn long, text string")
    turns.write.parquet(str(tmp_path / "turns"))
    s = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns"))
    q = streams.fold_turn_stream(s, 500).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["conv_id"], r["n_turns"], r["chars"], r["stop_turn"]) for r in spark.table("folded").collect()}
    want = {(r["conv_id"], r["n_turns"], r["chars"], r["stop_turn"]) for r in streams.fold_turns(turns, 500).where("stop_turn is not null").collect()}
    assert got == want == {(1, 2, 600, 1)}


def test_turn_stream_takes_late_turns(spark, tmp_path):
    """Turns out of order over several batches, conversations without an end, ties and null texts: the last row of each equals the batch fold."""
    schema = "conv_id long, turn long, text string"
    parts = [[(1, 1, "b" * 300), (2, 0, "x")], [(1, 0, "a" * 300), (3, 5, None)], [(1, 2, "c"), (2, 3, "y" * 499), (2, 3, "z")], [(2, 1, "w" * 9), (3, 5, "v")]]
    source = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    s = streams.fold_turn_stream(spark.readStream.schema(schema).parquet(source), 500, "update")
    last = {}

    def note(batch, n):
        last.update({r["conv_id"]: tuple(r) for r in batch.collect()})

    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        s.writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    every = spark.createDataFrame([(c, t, x or "") for p in parts for c, t, x in p], schema)
    assert last == {r["conv_id"]: tuple(r) for r in streams.fold_turns(every, 500).collect()}


def test_record_stream_parses_each_task_once(spark, tmp_path):
    rows = [("t1", "d", "m", 1, '[{"bbox_2d":[0,0,500,500],"label":"cat"}]', "2024-01-01 00:00:00"), ("t1", "d", "m", 1, "[]", "2024-01-01 00:00:01")]
    r = spark.createDataFrame(rows, "task_key string, dataset string, mode string, image_id long, raw_response string, completed_at string").withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    r.coalesce(1).write.parquet(str(tmp_path / "rec"))
    images = spark.createDataFrame([("d", 1, 100, 100)], "dataset string, image_id long, width int, height int")
    cats = spark.createDataFrame([("d", 3, "cat")], "dataset string, category_id int, name string")
    d = streams.stream_detections(spark.readStream.schema(r.schema).parquet(str(tmp_path / "rec")), images, cats)
    q = d.writeStream.format("memory").queryName("dets").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dets").count() == 1
    rate = streams.stream_request_rate(spark.readStream.schema(r.schema).parquet(str(tmp_path / "rec")))
    q = rate.writeStream.format("memory").outputMode("complete").queryName("rate").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rate").agg(F.max("calls")).first()[0] == 2


def test_stream_progress_stays_on_executors(spark, tmp_path):
    """Batch after batch, the latest state of each task is in the shared folder and no table is held in memory."""
    schema = "event_id long, task_key string, mode string, status string, completed_at timestamp"
    at = [(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime() for i in range(4)]
    end = runs.TERMINAL[0] if isinstance(runs.TERMINAL, (list, tuple)) else sorted(runs.TERMINAL)[0]
    rows = [[(1, "a", "m", "waiting", at[0]), (2, "b", "m", "waiting", at[0])], [(3, "a", "m", end, at[1])], [(4, "a", "m", "waiting", at[2]), (5, "b", "m", "again", at[3])]]
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.createDataFrame([], schema).write.parquet(source)
    for part in [[], *rows]:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        q = streams.stream_progress(spark.readStream.schema(schema).parquet(source), path, f"{path}-checkpoint")
        q.awaitTermination()
        got = sorted(map(tuple, streams.progress_table(spark, path).collect()))
        assert bool(got) == bool(part)
    assert got == [("a", "m", end), ("b", "m", "again")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("latest_")]


ARM = {"mode": "a", "formulation": "multi", "semantics": "class_names", "representation": "numeric", "box_count": 2}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"formulation": "all"}, "formulation"), ({"semantics": "names"}, "semantics"), ({"representation": "crop"}, "representation"), ({"reasoning_effort": "high"}, "reasoning_effort"), ({"instruction_mode": "annotator"}, "instruction_mode"),
        ({"box_count": 11}, "box_count"), ({"box_count": -1}, "box_count"), ({"box_count": 0}, "no_boxes_but_representation"), ({"representation": "none"}, "boxes_without_representation"),
        ({"semantics": "anonymous_explicit", "box_count": 0, "representation": "none"}, "anonymous_without_references"), ({"semantics": "anonymous_minimal", "box_count": 0, "representation": "none"}, "anonymous_without_references"),
        ({"semantics": "self_name_only"}, "self_name_only_with_references"), ({"explicit_sparse_references": True, "box_count": 0, "representation": "none"}, "sparse_without_references"), ({"all_available_references": True}, "all_available_needs_ten"),
        ({"group_reference_instances_by_image": True, "representation": "drawn"}, "grouped_needs_numeric"), ({"instruction_mode": "permuted", "semantics": "self_name"}, "instructions_need_class_names"), ({"mode": "b"}, "mode_repeated"),
        ({"boxes": 2}, "unknown_field"), ({"semantics": None}, "semantics_missing"),
    ],
)
def test_each_condition_rule(spark, tmp_path, change, rule):
    (tmp_path / "c.json").write_text(json.dumps([{**ARM, "mode": "b"}, {**ARM, **change}]))
    arms = files.parse_conditions(spark.read.text(str(tmp_path / "c.json"), wholetext=True))
    found = [v for x in files.condition_violations(arms).collect() for v in x["violations"]]
    assert set(found) == {rule}
    with pytest.raises(merge.ContractError, match=rule):
        files.read_conditions(spark, str(tmp_path / "c.json"))


def test_conditions_are_read_with_defaults(spark, tmp_path):
    full = {**ARM, "mode": "full", "box_count": 10, "all_available_references": True, "group_reference_instances_by_image": True, "explicit_sparse_references": True, "reasoning_effort": "low", "seed": 5, "instruction_mode": "strict_permuted"}
    (tmp_path / "c.json").write_text(json.dumps({"conditions": [ARM, full]}, indent=2))
    got = {r["mode"]: r.asDict() for r in files.read_conditions(spark, str(tmp_path / "c.json")).collect()}
    assert got["full"] == full
    assert got["a"] == ARM | {"reasoning_effort": "none", "seed": 1234, "group_reference_instances_by_image": False, "explicit_sparse_references": False, "all_available_references": False, "instruction_mode": "none"}
    for text in ("[]", '{"conditions": []}', '{"arms": 1}', "not json"):
        (tmp_path / "none.json").write_text(text)
        with pytest.raises(merge.ContractError, match="at least one"):
            files.read_conditions(spark, str(tmp_path / "none.json"))


def test_fingerprints_follow_every_part_of_a_request(spark):
    images = spark.createDataFrame([("d", 1, "a.jpg"), ("d", 2, "b.jpg"), ("d", 9, "ref.jpg")], "dataset string, image_id long, file_name string")
    m = spark.createDataFrame([("d", "m", 1, None, "k1"), ("d", "m", 2, 0, "k2"), ("d", "m", 2, 1, "k3")], "dataset string, mode string, image_id long, category_id int, task_key string")
    shown = [("d", 0, 9, 1, '[{"label":"cat"}]'), ("d", 1, 9, 1, '[{"label":"dog"}]')]
    kind = "dataset string, category_id int, image_id long, part int, payload string"

    def of(prompt="p", payloads=shown, files=images, settings=None):
        d = tasks.full_fingerprint(m, spark.createDataFrame(payloads, kind), files, prompt, settings or {"s": "1"})
        return {x["task_key"]: x["fingerprint"] for x in d.collect()}

    base = of()
    changed = lambda other: {k for k in base if base[k] != other[k]}
    assert len(set(base.values())) == 3 and of() == base
    assert changed(of(prompt="q")) == changed(of(settings={"s": "2"})) == {"k1", "k2", "k3"}
    assert changed(of(payloads=[shown[0], ("d", 1, 9, 1, '[{"label":"hound"}]')])) == {"k1", "k3"}
    assert changed(of(files=images.replace("b.jpg", "c.jpg", "file_name"))) == {"k2", "k3"}
    assert changed(of(files=images.replace("ref.jpg", "other.jpg", "file_name"))) == {"k1", "k2", "k3"}
    assert changed(of(payloads=shown[:1])) == {"k1", "k3"}


def test_large_sets_have_one_hash(spark):
    rows = [(g, i, None if i % 5 else "x") for g, n in (("a", 1), ("b", 4), ("c", 5), ("d", 70)) for i in range(n)]
    schema = "g string, i int, s string"
    sha = lambda x, width=4: {r["g"]: r["sha"] for r in tasks.large_set_sha(spark.createDataFrame(x, schema).repartition(3), ["g"], ["i", "s"], width).collect()}
    base = sha(rows)
    assert len(set(base.values())) == 4 and sha(rows[::-1]) == base
    assert {g for g, v in sha([*rows, ("d", 3, None)]).items() if v != base[g]} == {"d"}
    assert {g for g, v in sha([("c", 4, "null") if r == ("c", 4, None) else r for r in rows]).items() if v != base[g]} == {"c"}
    assert {g for g, v in sha(rows, 100).items() if v != base[g]} == {"c", "d"}


def test_snapshot_changes_at_three_levels(spark):
    images, objects = "dataset string, image_id long, file_name string", "dataset string, image_id long, ann_id long, category_id int, note string"
    old_i = [("same", 1, "a"), ("gone", 1, "a"), ("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("d", 4, "e")]
    new_i = [("same", 1, "a"), ("new", 1, "a"), ("d", 1, "a"), ("d", 2, "b2"), ("d", 3, "c"), ("d", 5, "f")]
    old_a = [("same", 1, 1, 0, None), ("gone", 1, 2, 0, "x"), ("d", 1, 3, 0, None), ("d", 3, 4, 0, None), ("d", 3, 5, 0, "x"), ("d", 4, 6, 0, "x"), ("d", 3, 8, 1, "same")]
    new_a = [("same", 1, 1, 0, None), ("d", 1, 3, 0, None), ("d", 3, 4, 0, "null"), ("d", 3, 7, 0, "x"), ("d", 3, 8, 1, "same")]
    snap = lambda i, a: (spark.createDataFrame(i, images), spark.createDataFrame(a, objects))
    got = {tuple(x) for x in validate.snapshot_changes(snap(old_i, old_a), snap(new_i, new_a)).collect()}
    assert got == {
        ("dataset", "gone", None, None, "missing"), ("dataset", "new", None, None, "extra"), ("dataset", "d", None, None, "changed"),
        ("image", "d", 2, None, "changed"), ("image", "d", 3, None, "changed"), ("image", "d", 4, None, "missing"), ("image", "d", 5, None, "extra"),
        ("annotation", "d", 3, 4, "changed"), ("annotation", "d", 3, 5, "missing"), ("annotation", "d", 3, 7, "extra"),
    }
    assert validate.snapshot_changes(snap(old_i, old_a), snap(old_i[::-1], old_a[::-1])).count() == 0
