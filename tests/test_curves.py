"""Precision curves of large classes and of samples of images; plans that must not copy their work."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxyard.operators import coco, curves, parsing, ranges, stats

GT = "dataset string, image_id long, category_id int, ann_id long, x double, y double, w double, h double"
PRED = "dataset string, mode string, image_id long, category_id int, x double, y double, w double, h double, score double, det_ord long"


def area(tp, ignored, objects):
    """Mean over 101 recalls of the best precision from the first position that reaches each."""
    tps, n = np.cumsum(tp), np.cumsum(~ignored)
    p = np.where(ignored, 0, tps / (n + 2.220446049250313e-16))
    best = np.maximum.accumulate(p[::-1])[::-1]
    at = np.searchsorted(tps / objects, np.arange(101) * 0.01, "left")
    return best[at[at < len(tp)]].sum() / 101


def test_a_class_of_a_million_detections(spark):
    """One class is dealt over many ranges, all scores of a tenth of it are the same, and no range holds it."""
    n = 1_000_000
    h = F.xxhash64("id")
    d = spark.range(n, numPartitions=8).select(
        F.lit("d").alias("dataset"), F.lit("m").alias("mode"), F.lit(1).alias("category_id"), (F.pmod(h, F.lit(900)) / 1000 + F.when(F.col("id") % 10 == 0, 0.1).otherwise(0.0)).alias("score"),
        F.col("id").alias("image_id"), F.lit(1).cast("long").alias("det_ord"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("long").bitwiseAND(F.lit(3).cast("long"))).alias("tp"),
        F.when(F.col("id") % 7 == 0, F.lit(2).cast("long")).otherwise(F.lit(0).cast("long")).alias("ignored"),
    )
    d = d.withColumn("tp", F.col("tp").bitwiseAND(F.bitwise_not("ignored")))
    ranked = curves.sorted_detections(d)
    sizes = [x["count"] for x in ranked.groupBy("_range").count().collect()]
    assert len(sizes) > 3 and max(sizes) < n / 2
    objects = spark.createDataFrame([("d", 1, 0, [600_000.0]), ("d", 1, 1, [500_000.0])], "dataset string, category_id int, cell int, npig array<double>")
    got = {x["cell"]: x["ap"][0] for x in curves.average_precisions(ranked, 2, objects).collect()}
    p = d.toPandas().sort_values(["score", "image_id"], ascending=[False, True])
    for k, objects_k in ((0, 600_000), (1, 500_000)):
        want = area((p.tp.to_numpy() >> k & 1).astype(bool), (p.ignored.to_numpy() >> k & 1).astype(bool), objects_k)
        assert abs(got[k] - want) < 1e-9


def test_numbered_over_ranges(spark):
    rows = [(g, int(x)) for g, n in (("a", 5000), ("b", 1), ("c", 300)) for x in np.random.default_rng(0).permutation(n)]
    got = ranges.numbered(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"]).toPandas()
    assert len(got) == len(rows) and (got.pos == got.x).all() and (got.total == got.g.map({"a": 5000, "b": 1, "c": 300})).all()
    assert ranges.numbered(spark.createDataFrame([], "g string, x int"), ["g"], ["x"]).count() == 0


def boxes(spark):
    r = np.random.default_rng(4)
    g, p = [], []
    score = lambda: int(r.integers(0, 3)) / 2 + len(p) % 40 / 1000  # noqa: E731  ties between images, none inside one
    for image in range(12):
        for c in (0, 1):
            for k in range(int(r.integers(0, 4))):
                x, y = (float(v) for v in r.integers(0, 200, 2))
                g.append(("d", image, c, 100 * image + 10 * c + k, x, y, 40.0, 30.0))
                for mode, shift, keep in (("a", 8, 0.6), ("b", 3, 0.9)):
                    if r.random() < keep:
                        p.append(("d", mode, image, c, x + float(r.integers(-shift, shift)), y, 40.0, 30.0, score(), len(p)))
                    if r.random() < 0.3:
                        p.append(("d", mode, image, c, x + 90, y, 40.0, 30.0, score(), len(p)))
    g.append(("e", 1, 0, 9000, 0.0, 0.0, 10.0, 10.0))
    p.append(("e", "a", 1, 0, 0.0, 0.0, 10.0, 10.0, 1.0, 1))
    images = [("d", i) for i in range(14)] + [("e", 1), ("e", 2)]
    return spark.createDataFrame(g, GT), spark.createDataFrame(p, PRED), spark.createDataFrame(images, "dataset string, image_id long")


def test_samples_score_like_tables_of_copies(spark, monkeypatch):
    """Every sample against the scores of a table in which an image stands as often as it was drawn; images by two tasks."""
    monkeypatch.setattr(stats, "_IMAGES", 5)
    g, p, images = boxes(spark)
    its, seeds = 3, (7, 11)
    got = {(x["dataset"], x["mode"], x["seed"], x["it"]): (x["ap"], x["ap50"]) for x in stats.sampled_scores(g, p, images, its, seeds).collect()}
    samples = [(None, None)] + [(s, i) for s in seeds for i in range(its)]
    assert len(got) == 2 * len(samples) + sum(1 for k in got if k[0] == "e")
    ids = list(range(14))
    for seed, it in samples:
        drawn = ids if seed is None else [ids[(seed + it * 7919 + pos * 104729) * 48271 % 2147483647 % 14] for pos in range(14)]
        copies = spark.createDataFrame([(i, 100 * i + k) for i in set(drawn) for k in range(drawn.count(i))], "image_id long, new long")
        again = lambda t: t.where("dataset = 'd'").join(copies, "image_id").drop("image_id").withColumnRenamed("new", "image_id")  # noqa: E731, B023
        g2 = again(g).withColumn("ann_id", F.col("ann_id") * 100 + F.col("image_id") % 100)
        c = coco.coco_score(g2, again(p), ("all",), (500,)).collect()
        for x in c:
            ap, ap50 = got[("d", x["mode"], seed, it)]
            assert abs(ap - 100 * x["ap"]) < 1e-9 and abs(ap50 - 100 * x["ap50"]) < 1e-9
    assert got[("e", "a", None, None)] == (100.0, 100.0) and got[("e", "b", None, None)] == (0.0, 0.0) if ("e", "b", None, None) in got else True
    b = stats.ap_bootstrap(g, p, images, "a", "b", its, seeds)
    r = {(x["dataset"], x["seed"], x["metric"]): x for x in b.collect()}
    deltas = [got[("d", "b", 7, i)][0] - got[("d", "a", 7, i)][0] for i in range(its)]
    x = r[("d", 7, "ap")]
    assert abs(x["mean"] - np.mean(deltas)) < 1e-9 and abs(x["low"] - np.percentile(deltas, 2.5)) < 1e-9 and x["p_better"] == np.mean([v > 0 for v in deltas])
    assert abs(x["point"] - (got[("d", "b", None, None)][0] - got[("d", "a", None, None)][0])) < 1e-9


def test_draws_are_counted():
    t = pa.table({"dataset": ["d"] * 4, "image_id": [10, 11, 12, 13], "pos": [3, 4, 5, 6], "total": [9] * 4})
    got = stats._counted_draws(t, 2, (5,))
    w = np.array([np.frombuffer(x, np.uint16) for x in got.column("weights").to_pylist()])
    for it in range(2):
        picks = [(5 + it * 7919 + pos * 104729) * 48271 % 2147483647 % 9 for pos in range(9)]
        assert w[:, 1 + it].tolist() == [picks.count(i) for i in (3, 4, 5, 6)]
    assert (w[:, 0] == 1).all()


def test_recalls_of_first_detections(spark):
    g, p, _ = boxes(spark)
    one_pass = {(x["dataset"], x["mode"]): x for x in coco.coco_recalls(g, p, (1, 2, 500)).collect()}
    for n in (1, 2, 500):
        for x in coco.coco_score(g, p, ("all",), (n,)).collect():
            assert abs(one_pass[(x["dataset"], x["mode"])][f"ar_{n}"] - x[f"ar_{n}"]) < 1e-12


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_are_parsed_once(spark):
    """What is done with the boxes later does not copy the parsing."""
    r = spark.createDataFrame([('[{"bbox_2d":[1,2,3,4],"label":"a"}]', "stop")], "raw_response string, finish_reason string")
    d = parsing.parse_responses(r)
    users = d.select("status", F.explode("dets").alias("d")).select("status", "d.label", F.get("d.bbox", F.lit(0)).alias("x1"), F.get("d.bbox", F.lit(1)).alias("y1"))
    for x in (d, users, d.where("status = 'ok'").select(F.size("dets"))):
        assert plan_of(x).count("from_json") <= 10
    assert users.toPandas().equals(pd.DataFrame({"status": ["ok"], "label": ["a"], "x1": [1.0], "y1": [2.0]}))


def test_repeats_of_different_images_are_an_error(spark):
    p = spark.createDataFrame([("d", m, 1, 0, 0.0, 0.0, 10.0, 10.0, 1.0, 1) for m in ("a", "b", "c")] + [("d", "a", 2, 0, 0.0, 0.0, 10.0, 10.0, 1.0, 1), ("d", "b", 2, 0, 1.0, 0.0, 10.0, 10.0, 1.0, 1)], PRED)
    rows = [("d", i, m, "x" if i < 3 else m) for i in (1, 2, 3, 4) for m in ("a", "b", "c")]
    answers = spark.createDataFrame(rows, "dataset string, image_id long, mode string, raw_response string")
    r = stats.repeat_agreement(p, answers).collect()[0]
    # image 1 is alike; of 2 two repeats agree at 9/11 and one found nothing; 3 and 4 are bare
    assert (r["n_images"], r["n_repeats"], r["n_pairs"], r["n_matches"]) == (4, 3, 12, 4) and r["same_answer"] == 0.5 and r["same_content"] == r["same_count"] == 0.75
    assert abs(r["mean_f1"] - (3 + 1 + 6) / 12) < 1e-12 and abs(r["mean_iou"] - (3 + 90 / 110) / 4) < 1e-12
    with pytest.raises(Exception, match="repeats cover different images of d"):
        stats.repeat_agreement(p, answers.where("not (image_id = 4 and mode = 'c')")).collect()


def test_cluster_effects_by_brute_force(spark):
    r = np.random.default_rng(6)
    rows = [("m", f"d{k:02}", int(r.integers(0, 2)), float(r.integers(0, 5)), float(r.normal())) for k in range(12) for _ in range(int(r.integers(2, 9)))]
    d = spark.createDataFrame(rows, "mode string, dataset string, flag int, x double, y double")
    got = {x["kind"]: x for x in stats.cluster_effects(d, ["mode"], ["flag"], ["x"], "y", 200, 7).collect()}
    names = sorted({x[1] for x in rows})

    def effects(some):
        f, x, y = (np.array([v[i] for v in some], float) for i in (2, 3, 4))
        return y[f == 1].mean() - y[f == 0].mean(), np.polyfit(x, y, 1)[0]

    draws = []
    for it in range(200):
        picked = [names[(7 + it * 7919 + pos * 104729) * 48271 % 2147483647 % 12] for pos in range(12)]
        draws.append(effects([x for n in picked for x in rows if x[1] == n]))
    for i, kind in enumerate(("flag", "slope")):
        x = got[kind]
        assert abs(x["estimate"] - effects(rows)[i]) < 1e-9 and x["n_valid"] == 200
        assert np.allclose([x["low"], x["high"]], np.percentile([v[i] for v in draws], [2.5, 97.5]))
    with pytest.raises(Exception, match="too few draws"):
        stats.cluster_effects(d.withColumn("flag", F.lit(1)), ["mode"], ["flag"], [], "y", 50, 7).collect()
    with pytest.raises(Exception, match="too few draws"):
        stats.cluster_effects(d.withColumn("x", F.lit(0.1)), ["mode"], [], ["x"], "y", 50, 7).collect()


def test_cut_lists_are_read_without_the_helper(spark, monkeypatch):
    """What expressions read of lists that break off is what the helper reads, for every place to cut and odd forms; only odd forms need it."""
    b = lambda x, label="a", key="bbox_2d", name="label": f'{{"{key}":[{x},2,3,4],"{name}":"{label}"}}'
    whole = [f"[{b(1)},{b(5, 'b')},{b(1)}, {b(7)} ,{b(7)}]", f'{{"objects": [{b(1)},\n{b(2, key="bbox", name="class")},{b(1)}]}}', f'[{{"bbox":[1.5,2.25,3.0,4.0],"label":"x"}},{{"bbox":[1.50,2.25,3.0,4.0],"label":"x"}},']
    texts = [w[:n] for w in whole for n in range(1, len(w) + 1)]
    odd = [f"[{b(1)},{b('1.0')},{{", f"[{b('-0')},{b(0)},", f"[{b('01')},", f"[{b(1)},[", f"[{b(1)}] {{", f"[{b(1)},\x0b{{", f'[{{"bbox":[1,2,3,4],"label":"}}"}},', f"[{b(1)},{{'a':{b(2)}", f"[{b(1)},{{\"x\":[1]],", f"[{','.join(b(i % 300) for i in range(700))},{{", f"```[{b(1)},{{```", f"<think>[</think>[{b(1)},{b(2)},{{\"bbox_2d\":"]
    texts += odd
    d = spark.createDataFrame(list(enumerate(texts)), "i int, raw_response string")
    got = {x["i"]: (x["status"], [(list(v["bbox"]), v["label"]) for v in x["dets"]]) for x in parsing.parse_responses(d).collect()}
    for i, text in enumerate(texts):
        status, dets = parsing.salvage(text)
        assert got[i] == (status, [(list(box), label) for box, label in dets]), text
    seen = spark.sparkContext.accumulator(0)

    def counted(some):
        seen.add(int(some.notna().sum()))
        return pd.DataFrame({"status": ["helper"] * len(some), "dets": [[] for _ in some]})

    counted.__annotations__ = {"some": pd.Series, "return": pd.DataFrame}
    monkeypatch.setattr(parsing, "parse_salvage", counted)
    r = spark.createDataFrame([(f"[{b(k)},{b(k + 1)},{{\"bbox_2d\":[1,2",) for k in range(50)], "raw_response string")
    assert {x["status"] for x in parsing.parse_responses(r).collect()} == {"salvaged"} and seen.value == 0
