"""Contracts of runs, totals and candidates that end in errors or in rows for what is wrong."""

import pytest

from boxyard.operators import references, runs, stats, validate

SCORES = "dataset string, mode string, box_count int, map5095 double, map50 double, prompt_tokens long, completion_tokens long, reasoning_tokens long, total_seconds double, model_failures long, errors long"


def candidates(spark, rows):
    d = spark.createDataFrame([(*r, 0.2, 0.4, 100, None, 0, 5.0, 1, 0) for r in rows], SCORES)
    n = spark.createDataFrame([("a", 10), ("b", 20), ("c", 1)], "dataset string, n_images long")
    return runs.candidate_rows(d, n, ["a", "b"], ["box_count"]).collect()


def test_candidates_must_agree(spark):
    (r,) = candidates(spark, [("a", "m", 1), ("b", "m", 1), ("c", "other", 9)])
    assert (r["box_count"], r["prompt_tokens_per_image"], r["completion_tokens_per_image"], r["model_failures"]) == (1, 7.5, 0.0, 2)
    for rows in ([("a", "m", 1)], [("a", "m", 1), ("a", "m", 1)], [("a", "m", 1), ("b", "m", 2)], [("a", "m", 1), ("b", "m", 1), ("b", "n", 1)]):
        with pytest.raises(Exception, match="differ"):
            candidates(spark, rows)


def test_contrasts_are_paired(spark):
    rows = [("d", m, k, v + k) for m, v in (("two", 3.0), ("one", 1.0)) for k in range(3)]
    s = "dataset string, mode string, repeat int, map5095 double"
    got = {r["dataset"]: r for r in stats.count_contrasts(spark.createDataFrame(rows, s), [("two", "one")]).collect()}
    assert set(got) == {"d", "macro"} and all((r["n"], r["mean"], r["sd"], r["low"], r["high"]) == (3, 2.0, 0.0, 2.0, 2.0) for r in got.values())
    with pytest.raises(Exception, match="without a partner"):
        stats.count_contrasts(spark.createDataFrame(rows[:-1], s), [("two", "one")]).collect()


def test_sums_and_totals(spark):
    told = spark.createDataFrame([("d", "m", 10, None), ("e", "m", 1, 1)], "dataset string, mode string, prompt_tokens long, completion_tokens long")
    records = spark.createDataFrame([("d", "m", 4, None), ("d", "m", 6, None), ("f", "m", 2, 0)], "dataset string, mode string, prompt_tokens long, completion_tokens long")
    got = {tuple(r) for r in validate.token_sums(told, records).collect()}
    assert got == {("e", "m", "prompt_tokens", 1, None), ("e", "m", "completion_tokens", 1, None), ("f", "m", "prompt_tokens", None, 2), ("f", "m", "completion_tokens", None, 0)}
    i = spark.createDataFrame([("d", 1, 2), ("total", 1, 2)], "dataset string, n_images long, n_classes long")
    assert [tuple(r) for r in validate.expected_totals(i, {"n_images": 1, "n_classes": 3}).collect()] == [("n_classes", 3, 2)]


def test_failures_are_counted(spark):
    rows = [("d", "success", None), ("d", "model_failure", "timeout"), ("d", "model_failure", None), ("d", "model_failure", "new"), ("d", "error", "timeout"), ("d", None, None)]
    (r,) = runs.failure_counts(spark.createDataFrame(rows, "dataset string, status string, failure_type string")).collect()
    assert tuple(r) == ("d", 4, 1, 1, 3, 1, 0, 0, 2)


def test_classes_left_empty(spark):
    refs = spark.createDataFrame([("d", 1, 7), ("d", 1, 7), ("d", 2, 7), ("d", 2, 8), ("d", 3, 9), ("e", 1, 7)], "dataset string, category_id int, image_id long")
    images = spark.createDataFrame([("d", 7), ("d", 8), ("e", 6)], "dataset string, image_id long")
    assert [tuple(r) for r in references.empty_reference_classes(refs, images).collect()] == [("d", 7, 1)]
