"""Matching of boxes: candidate pairs, greedy one-to-one pairs, recall, agreement.

Greedy matching takes pairs by falling overlap (ties: larger left id, then larger right id) and skips those with a side
already taken. A group is the boxes of one image and class; its pairs are folded in the order of a sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxyard.functions.geometry import box, iou

BOX = ("x", "y", "w", "h")


def match_candidates(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, iou_min: float) -> DataFrame:
    """Pairs on equal keys with at least that overlap: keys, l, r, iou."""
    a = left.select(*keys, F.col(left_id).cast("long").alias("l"), *BOX).alias("a")
    b = right.select(*keys, F.col(right_id).cast("long").alias("r"), *BOX).alias("b")
    pairs = a.join(b, keys).select(*keys, "l", "r", iou(box("a"), box("b")).alias("iou"))
    return pairs.where(F.col("iou") >= iou_min)


def fold_greedy(pairs: Column) -> Column:
    """From an array of struct(iou, l, r) in matching order the pairs that are taken."""
    kind = "array<struct<iou:double,l:bigint,r:bigint>>"

    def take(taken: Column, p: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["l"] == p["l"]) | (t["r"] == p["r"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(F.struct(p["iou"].alias("iou"), p["l"].cast("long").alias("l"), p["r"].cast("long").alias("r")))))

    return F.aggregate(pairs, F.array().cast(kind), take)


def greedy_match(candidates: DataFrame, keys: list[str], threshold: float | None = None) -> DataFrame:
    """One row per taken pair: keys, l, r, iou."""
    c = candidates if threshold is None else candidates.where(F.col("iou") >= threshold)
    groups = c.groupBy(*keys).agg(F.collect_list(F.struct("iou", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("p"))
    return groups.select(*keys, F.inline(taken_pairs("p"))).select(*keys, "l", "r", "iou")


def taken_pairs(pairs: str | Column) -> Column:
    """From an array of struct(iou, l, r) in any order the pairs that are taken. Only where pairs compete are they sorted and folded."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    alone = lambda side: F.size(F.array_distinct(p[side])) == F.size(p)
    return F.when(alone("l") & alone("r"), p).otherwise(fold_greedy(F.sort_array(p, asc=False)))


#: What an object and a detection have to have in common.
SAME = ["dataset", "image_id", "category_id"]


#: Their names in side_by_side().
PLACE = [f"_{c}" for c in SAME]


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both, with the columns of SAME as PLACE.

    Spark sees that a union's sides are dealt alike only if their keys have the same names and no table's name before them,
    which new names give.
    """
    of = lambda d: d.select(*[F.col(c).alias(p) for p, c in zip(PLACE, SAME, strict=True)], *[c for c in d.columns if c not in SAME])
    return of(a).unionByName(of(b))


def meet(objects: DataFrame, detections: DataFrame) -> DataFrame:
    """(SAME, g, p) of rows (SAME, g) and (SAME, p): lists of both for each image and class.

    Both sides are grouped in one pass by keys without the mode, so objects are not copied for each mode. Sides that are dealt
    by image already are not dealt again. Rows with a null among the keys meet nothing.
    """
    sides = {"g": objects, "p": detections}
    kinds = {n: d.schema[n].dataType for n, d in sides.items()}
    d = side_by_side(*[d.select(*SAME, *[F.col(c) if c == n else F.lit(None).cast(kinds[c]).alias(c) for c in kinds]) for n, d in sides.items()])
    d = d.groupBy(*PLACE).agg(F.collect_list("g").alias("g"), F.collect_list("p").alias("p")).select(*[F.col(p).alias(c) for p, c in zip(PLACE, SAME, strict=True)], "g", "p")
    lacking = F.greatest(*[F.col(c).isNull() for c in SAME])
    none = {n: F.filter(n, lambda x: F.lit(False)).alias(n) for n in kinds}
    apart = F.array(F.struct("g", none["p"]), F.struct(none["g"], "p"))
    return d.select(*SAME, F.inline(F.when(lacking, apart).otherwise(F.array(F.struct("g", "p")))))


def _met(gt: DataFrame, predictions: DataFrame) -> DataFrame:
    """(SAME, g, p): the objects (l, lx, ly, lw, lh) and the detections (mode, r, rx, ry, rw, rh) of each image and class."""
    g = gt.select(*SAME, F.struct(F.col("ann_id").cast("long").alias("l"), *[F.col(v).alias(f"l{v}") for v in BOX]).alias("g"))
    return meet(g, predictions.select(*SAME, F.struct("mode", F.col("det_ord").cast("long").alias("r"), *[F.col(v).alias(f"r{v}") for v in BOX]).alias("p")))


def _overlap() -> Column:
    return iou([F.col(f"l{v}") for v in BOX], [F.col(f"r{v}") for v in BOX])


def object_candidates(gt: DataFrame, predictions: DataFrame, iou_min: float) -> DataFrame:
    """match_candidates() of objects, which have no mode, with the detections of every mode: dataset, mode, image_id, category_id, l, r, iou."""
    d = _met(gt, predictions).where(F.size("g") > 0).select(*SAME, "g", F.inline("p")).select(*SAME, "mode", "r", *[f"r{v}" for v in BOX], F.inline("g"))
    return d.select("dataset", "mode", "image_id", "category_id", "l", "r", _overlap().alias("iou")).where(F.col("iou") >= iou_min)


#: Thresholds of known-object recall; the ninth is exactly 0.9.
RECALL_THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def known_object_recall(gt: DataFrame, predictions: DataFrame, thresholds: list[float] = RECALL_THRESHOLDS) -> DataFrame:
    """Recall of labelled objects where labels are not exhaustive: one row for each (dataset, mode, category_id).

    recall50 and recall (mean over the thresholds); predictions without a partner count nothing.
    """
    keys = ["dataset", "mode", "image_id", "category_id"]
    modes = predictions.select("dataset", "mode").distinct()
    objects = gt.groupBy("dataset", "category_id").agg(F.count(F.lit(1)).alias("n_objects")).join(modes, "dataset")
    g = gt.join(modes, "dataset")
    c = match_candidates(g, predictions, keys, "ann_id", "det_ord", min(thresholds))
    groups = c.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("iou", "l", "r")), asc=False).alias("p"))

    def found(t: float) -> Column:
        return F.size(fold_greedy(F.filter("p", lambda x: x["iou"] >= t)))

    counts = [found(t).alias(f"m{i}") for i, t in enumerate(thresholds)]
    per_image = groups.select(*keys, *counts)
    total = per_image.groupBy("dataset", "mode", "category_id").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(thresholds))])
    j = objects.join(total, ["dataset", "mode", "category_id"], "left").na.fill(0)
    mean = sum((F.col(f"m{i}") for i in range(1, len(thresholds))), F.col("m0")) / (F.col("n_objects") * float(len(thresholds)))
    return j.select("dataset", "mode", "category_id", "n_objects", F.col("m0").cast("long").alias("n_found50"), (F.col("m0") / F.col("n_objects")).alias("recall50"), mean.alias("recall"))


def recall_summary(by_category: DataFrame) -> DataFrame:
    """Micro and class-macro recall of each (dataset, mode)."""
    n = F.sum("n_objects")
    return by_category.groupBy("dataset", "mode").agg(
        (F.sum("n_found50") / n).alias("micro_recall50"), (F.sum(F.col("recall") * F.col("n_objects")) / n).alias("micro_recall"),
        F.avg("recall50").alias("macro_recall50"), F.avg("recall").alias("macro_recall"),
    )


def detection_agreement(predictions: DataFrame, images: DataFrame, pairs: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """For every image and pair of modes: n_left, n_right, n_matched, f1 (1.0 where both are empty), sum_iou."""
    spark = predictions.sparkSession
    grid = spark.createDataFrame(pairs, "mode_a string, mode_b string")
    p = predictions.select("dataset", "mode", "image_id", "category_id", "det_ord", *BOX)
    a = p.join(F.broadcast(grid), p["mode"] == grid["mode_a"]).drop("mode")
    b = p.join(F.broadcast(grid), p["mode"] == grid["mode_b"]).drop("mode")
    keys = ["dataset", "image_id", "mode_a", "mode_b"]
    m = greedy_match(match_candidates(a, b, [*keys, "category_id"], "det_ord", "det_ord", threshold), [*keys, "category_id"])
    matched = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"), F.sum("iou").alias("sum_iou"))
    counts = p.groupBy("dataset", "image_id", "mode").agg(F.count(F.lit(1)).alias("n"))
    full = images.select("dataset", "image_id").join(F.broadcast(grid))  # a stated list of pairs
    for side in ("a", "b"):
        full = full.join(counts.select("dataset", "image_id", F.col("mode").alias(f"mode_{side}"), F.col("n").alias(f"n_{side}")), ["dataset", "image_id", f"mode_{side}"], "left")
    full = full.join(matched, keys, "left").na.fill(0, ["n_a", "n_b", "n_matched"]).na.fill(0.0, ["sum_iou"])
    total = F.col("n_a") + F.col("n_b")
    return full.select(*keys, F.col("n_a").alias("n_left"), F.col("n_b").alias("n_right"), "n_matched", F.when(total == 0, 1.0).otherwise(2 * F.col("n_matched") / total).alias("f1"), "sum_iou")


def image_f1(gt: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(dataset, mode, image_id, category_id, n_gt, n_pred, n_matched, f1) wherever there is an object or a prediction."""
    modes = predictions.select("dataset", "mode").distinct().groupBy("dataset").agg(F.collect_list("mode").alias("modes"))
    d = _met(gt, predictions).join(F.broadcast(modes), "dataset", "left")  # one row per dataset
    # modes that detect nothing stand here with a detection that is none
    bare = F.transform(F.array_except("modes", F.col("p")["mode"]), lambda m: F.struct(m.alias("mode"), F.lit(None).cast("long").alias("r"), *[F.lit(None).cast(gt.schema[v].dataType).alias(f"r{v}") for v in BOX]))
    d = d.withColumn("p", F.when(F.col("modes").isNotNull() & (F.size("g") > 0), F.concat("p", bare)).otherwise(F.col("p"))).withColumn("n_gt", F.size("g").cast("long"))
    d = d.select(*SAME, "n_gt", "g", F.inline("p")).select(*SAME, "n_gt", "mode", "r", *[f"r{v}" for v in BOX], F.inline_outer("g"))
    near = F.when(_overlap() >= threshold, F.struct(_overlap().alias("iou"), "l", "r"))
    per = d.groupBy("dataset", "mode", "image_id", "category_id", "n_gt").agg(F.count("r").alias("_rows"), F.collect_list(near).alias("_pairs"))
    # a detection has a row for each object, or one
    n_pred = F.expr("_rows div greatest(n_gt, 1L)").alias("n_pred")
    j = per.select("dataset", "mode", "image_id", "category_id", "n_gt", n_pred, F.size(taken_pairs("_pairs")).cast("long").alias("n_matched"))
    total = F.col("n_gt") + F.col("n_pred")
    return j.withColumn("f1", F.when(total == 0, 1.0).otherwise(2 * F.col("n_matched") / total))


def most_changed_image(f1: DataFrame, before: str, after: str, direction: int = 1) -> DataFrame:
    """For each (dataset, category_id) the image with objects that gained (direction 1) or lost (-1) most f1; ties: fewer objects and predictions, larger id."""
    a = f1.where((F.col("mode") == before) & (F.col("n_gt") > 0)).select("dataset", "category_id", "image_id", F.col("f1").alias("f1_before"), "n_gt", F.col("n_pred").alias("p_a"))
    b = f1.where(F.col("mode") == after).select("dataset", "category_id", "image_id", F.col("f1").alias("f1_after"), F.col("n_pred").alias("p_b"))
    d = a.join(b, ["dataset", "category_id", "image_id"]).withColumn("delta", F.col("f1_after") - F.col("f1_before")).withColumn("clutter", F.col("n_gt") + F.col("p_a") + F.col("p_b"))
    best = F.max_by(F.struct("image_id", "f1_before", "f1_after", "delta"), F.struct(direction * F.col("delta"), -F.col("clutter"), F.col("image_id")))
    return d.groupBy("dataset", "category_id").agg(best.alias("b")).select("dataset", "category_id", "b.*")


def precision_recall(gt: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(dataset, mode, n_gt, n_pred, n_matched, precision, recall, f1) by greedy matching."""
    per = image_f1(gt, predictions, threshold).groupBy("dataset", "mode").agg(*[F.sum(c).alias(c) for c in ("n_gt", "n_pred", "n_matched")])
    return per.select("*", (F.col("n_matched") / F.col("n_pred")).alias("precision"), (F.col("n_matched") / F.col("n_gt")).alias("recall"), (2 * F.col("n_matched") / (F.col("n_gt") + F.col("n_pred"))).alias("f1"))
