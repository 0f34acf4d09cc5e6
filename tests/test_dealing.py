"""Boxes are dealt once, by image: what plans may not deal again, and that results stay."""

import gzip
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxyard.functions import counts, fixtures
from boxyard.operators import coco, matching, references, stats, tasks
from boxyard.operators.merge import ContractError
from boxyard.plans import table_queries
from boxyard.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Tables as if none of them could be broadcast, but for lists of a few rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    yield fixtures.load(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def dealt(df) -> list[str]:
    """By what the rows of a plan are dealt."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sorted(re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*), \d+\)", plan))


def test_predictions_are_those_of_the_text(spark):
    t = fixtures.load(spark, SF)
    for name in ("det_annotations", "det_predictions"):
        want = spark.sql(fixtures.TABLES[name])
        assert t[name].dtypes == want.dtypes
        assert t[name].exceptAll(want).count() == 0 and want.exceptAll(t[name]).count() == 0


def test_boxes_are_dealt_by_their_order_only(large):
    assert dealt(large["det_annotations"]) == dealt(large["det_predictions"]) == ["image_id", "l_orderkey"]


def test_matching_deals_no_boxes(large):
    """F4 c6_image_f1, F6 slice_macro_f1, F5 c2_coco_score, F10 c2_coco_summary: both sides stay where their image is."""
    a, p = large["det_annotations"], large["det_predictions"]
    assert not [x for x in dealt(matching.image_f1(a, p)) if "category_id" in x or "mode" in x and "image_id" in x]
    judged = coco.matched(a, p, coco.IOU_THRESHOLDS, ("all",), 500)
    assert set(dealt(judged)) == {"image_id", "l_orderkey"}


def test_sides_that_are_dealt_otherwise_meet_as_well(spark):
    t = fixtures.load(spark, SF)
    a, p = t["det_annotations"], t["det_predictions"]
    loose = [d.repartition(5, "x") for d in (a, p)]
    for f in (matching.image_f1, lambda a, p: coco.judged(a, p, [0.5, 0.75], ("all", "small"), 10)):
        want, got = f(a, p), f(*loose)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_draws_are_no_rows(spark):
    """F3 a14_image_bootstrap: images numbered by id, drawn as the documented hash tells; an image without an arm counts nothing there."""
    rows = [("d", "a", 30, 2, 1, 1), ("d", "b", 30, 2, 2, 2), ("d", "a", 10, 4, 2, 1), ("d", "b", 20, 1, 1, 0), ("d", "c", 5, 9, 9, 9), ("d", "a", 20, 1, 3, 1), (None, "a", 1, 1, 1, 1)]
    per = spark.createDataFrame(rows, "dataset string, mode string, image_id long, n_gt long, n_pred long, n_matched long")
    got = stats.image_bootstrap(per, "a", "b", 5, 3)
    images, of = [5, 10, 20, 30], {(r[1], r[2]): r[3:] for r in rows if r[0]}
    want = {}
    for it in range(5):
        picks = [images[(3 + it * 7919 + i * 104729) * 48271 % 2147483647 % 4] for i in range(4)]
        sums = {m: [sum(of.get((m, x), (0, 0, 0))[k] for x in picks) for k in range(3)] for m in "ab"}
        want[it] = 2 * sums["b"][2] / sum(sums["b"][:2]) - 2 * sums["a"][2] / sum(sums["a"][:2])
    assert {x["it"]: x["delta"] for x in got.collect()} == pytest.approx(want)
    assert not [x for x in dealt(got) if "pick" in x]
    assert got.where(F.col("it") < 0).count() == 0


def test_lists_are_compressed_and_read_whole(spark, tmp_path):
    """F1 s7_write_run, F8 s3_read_predictions: compressed lists hold the same text and boxes; one that is cut off is an error."""
    p = fixtures.load(spark, SF)["det_predictions"].where("dataset < 'ds02'").unionByName(spark.createDataFrame([("ds99", "names", 1, 0, 1.0, 2.0, 3.0, 4.0, 0.5, 1)], "dataset string, mode string, image_id long, category_id int, x double, y double, w double, h double, score double, det_ord int"))
    for name in ("none", "gzip"):
        files.write_predictions(p, str(tmp_path / name), name)
    packed = sorted((tmp_path / "gzip").glob("*/*/part-*"))
    plain = {x.parent.relative_to(tmp_path / "none"): x.read_bytes() for x in (tmp_path / "none").glob("*/*/part-*")}
    assert {x.parent.relative_to(tmp_path / "gzip"): gzip.decompress(x.read_bytes()) for x in packed} == plain
    assert sum(x.stat().st_size for x in packed) * 3 < sum(len(x) for x in plain.values())
    got, want = (files.read_predictions(spark, str(tmp_path / name), "*/*/part-*") for name in ("gzip", "none"))
    assert got.count() == p.count() and got.exceptAll(want).count() == 0
    (tmp_path / "cut" / "d").mkdir(parents=True)
    for text in (b'[{"image_id":1,"bbox":[1,2,3,4]}\n', b'[{"image_id":1,"bbox":[1,2'):
        (tmp_path / "cut" / "d" / "part-0.txt.gz").write_bytes(gzip.compress(text))
        with pytest.raises(ContractError):
            files.read_predictions(spark, str(tmp_path / "cut"), "*/part-*").collect()


def test_answers_are_made_where_their_boxes_are(large):
    """F2 t2_stream_detections: boxes are not dealt again to become answers."""
    assert not [x for x in dealt(table_queries.parsed_answers(large)) if x not in ("image_id", "_i", "l_orderkey", "dataset")]  # datasets are of their list


def test_hashes_are_dealt_as_bytes(spark):
    """F9 p8_conflicts: fingerprints of any form come back as they were, and hashes are half as long where they are dealt."""
    texts = ["ab" * 32, "AB" * 32, "abc", "", "ab\n", "\x01«", "ab", "ä"]
    d = spark.createDataFrame([(x,) for x in [*texts, None]], "f string").select("f", tasks._packed(F.col("f")).alias("p"))
    got = {x["f"]: (x["u"], x["n"]) for x in d.select("f", tasks._unpacked("p").alias("u"), F.octet_length("p").alias("n")).collect()}
    assert {k: v[0] for k, v in got.items()} == {x: x for x in [*texts, None]} and got["ab" * 32][1] == 33
    now = spark.createDataFrame([("a", "ab" * 32), ("b", "x"), ("c", "cd")], "task_key string, fingerprint string")
    records = spark.createDataFrame([("a", "AB" * 32, "success"), ("b", "x", "success"), ("c", "ef", "error"), ("b", "yy", "model_failure")], "task_key string, fingerprint string, status string")
    assert sorted(map(tuple, tasks.conflicts(now, records).collect())) == [("a", "ab" * 32, "AB" * 32), ("b", "x", "yy")]


def test_the_first_reference_is_no_sorted_class(large):
    """F9 p8_conflicts: a class's largest box meets the others where they are."""
    assert not [x for x in dealt(table_queries.with_area(large)) if x not in ("image_id", "_i", "l_orderkey")]
    d = references.seeded_random_references(table_queries.with_area(large), 4, 5)
    assert dealt(d).count("dataset, category_id") <= 2  # the largest of each part, and the first of each part
    assert "count(1) windowspec" not in d._jdf.queryExecution().executedPlan().toString()


def test_counts_take_two_bits():
    """F7 a14_ap_bootstrap: how often images are drawn is a quarter as long, and comes back for any number."""
    r = np.random.default_rng(1)
    for n in (1, 3, 4, 41):
        rows = r.poisson(1, (300, n)).astype(np.uint16)
        rows[7] = 65535 - np.arange(n)
        got = counts.packed(rows)
        assert (counts.unpacked(got) == rows).all()
    assert sum(map(len, got)) * 4 < rows.nbytes * 1.1
    assert counts.unpacked([]).shape[0] == 0
