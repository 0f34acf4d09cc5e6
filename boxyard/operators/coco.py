"""COCO scoring: per-image matching at many thresholds and area ranges, then precision and recall curves.

A detection, in the order of score and list position, takes the free object of highest overlap from the threshold on;
the later of equals wins, and an object outside the area range (or a crowd) is taken only if no other is left. That is
a fold over pairs in the order (score desc, position, ignored, overlap desc, object id desc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxyard.functions.geometry import AREAS, box, crowd_iou
from boxyard.operators.curves import CLASS, average_precisions, range_sums, sorted_detections
from boxyard.operators.judging import judge
from boxyard.operators.matching import BOX, SAME, side_by_side
from boxyard.sources.tables import keep

#: linspace(0.5, 0.95, 10), whose ninth value is below 0.9.
IOU_THRESHOLDS = [0.5 + (0.95 - 0.5) / 9 * i for i in range(9)] + [0.95]
GROUP = ["dataset", "mode", "image_id", "category_id"]


def _cells(thresholds: list[float], areas: tuple[str, ...]) -> list[tuple[float, str]]:
    return [(t, a) for t in thresholds for a in areas]


def ranked(predictions: DataFrame, max_dets: int) -> DataFrame:
    """The first max_dets detections of each image and class, with their rank."""
    w = W.partitionBy(*GROUP).orderBy(F.desc("score"), "det_ord")
    return predictions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_dets)


def with_defaults(gt: DataFrame) -> DataFrame:
    """Objects with iscrowd (0) and area (of the box) where they lack them."""
    if "iscrowd" not in gt.columns:
        gt = gt.withColumn("iscrowd", F.lit(0))
    return gt if "area" in gt.columns else gt.withColumn("area", F.col("w") * F.col("h"))


def _fold(pairs: Column) -> Column:
    """Of sorted struct(neg_score, det_ord, ig, neg_iou, neg_ann, ann_id, crowd) those whose sides are free when their turn comes."""
    kind = "array<struct<det_ord:bigint,ann_id:bigint,ig:int>>"

    def take(taken: Column, p: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["det_ord"] == p["det_ord"]) | ((t["ann_id"] == p["ann_id"]) & (p["crowd"] == 0)))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(F.struct(p["det_ord"].cast("long").alias("det_ord"), p["ann_id"].cast("long").alias("ann_id"), p["ig"].cast("int").alias("ig")))))

    return F.aggregate(pairs, F.array().cast(kind), take)


def _turns(near: Column, lo: Column, hi: Column) -> Column:
    """Pairs in the form that _fold() takes, for objects of an area range."""
    return F.transform(
        near,
        lambda x: F.struct(
            (-x["score"]).alias("neg_score"), x["det_ord"].alias("det_ord"),
            F.when((x["iscrowd"] == 1) | (x["gt_area"] < lo) | (x["gt_area"] > hi), 1).otherwise(0).alias("ig"),
            (-x["iou"]).alias("neg_iou"), (-x["ann_id"]).alias("neg_ann"), x["ann_id"].alias("ann_id"), x["iscrowd"].alias("crowd"),
        ),
    )


def _candidates(gt: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """(group, c, plain): the pairs of each image and class from the lowest threshold on; plain: no side is in two of them."""
    g = with_defaults(gt).select("dataset", "image_id", "category_id", "ann_id", "x", "y", "w", "h", F.col("area").alias("gt_area"), "iscrowd").alias("g")
    p = first.alias("p")
    c = p.join(g, ["dataset", "image_id", "category_id"]).select(*GROUP, "score", "det_ord", "ann_id", "gt_area", "iscrowd", crowd_iou(box("p"), box("g"), F.col("iscrowd")).alias("iou"))
    c = c.where(F.col("iou") >= least)
    groups = c.groupBy(*GROUP).agg(F.collect_list(F.struct("score", "det_ord", "iou", "ann_id", "gt_area", "iscrowd")).alias("c"))
    once = lambda f: F.size(F.array_distinct(F.transform("c", lambda x: x[f]))) == F.size("c")
    return groups.withColumn("plain", once("det_ord") & once("ann_id"))


def _outside(area: str) -> Column:
    """Whether an object of a pair does not count in an area range."""
    return (F.col("iscrowd") == 1) | (F.col("gt_area") < AREAS[area][0]) | (F.col("gt_area") > AREAS[area][1])


def _reaches(iou: Column, threshold: Column | float) -> Column:
    """A pair's overlap only has to reach the threshold, or 1 within rounding."""
    return iou >= F.least(F.lit(threshold) if isinstance(threshold, float) else threshold, F.lit(1 - 1e-10))


def _folded(groups: DataFrame, thresholds: list[float], areas: tuple[str, ...]) -> DataFrame:
    """(group, cell, thr, area, det_ord, ann_id, ig) of groups in which pairs compete."""
    cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(t).alias("thr"), F.lit(a).alias("area"), F.lit(AREAS[a][0]).alias("lo"), F.lit(AREAS[a][1]).alias("hi")) for i, (t, a) in enumerate(_cells(thresholds, areas))])
    e = groups.where(~F.col("plain")).select(*GROUP, "c", F.explode(cells).alias("k")).select(*GROUP, "c", "k.*")
    e = e.withColumn("near", F.filter("c", lambda x: _reaches(x["iou"], F.col("thr")))).where(F.size("near") > 0)
    near = F.col("near")
    keyed = _turns(near, F.col("lo"), F.col("hi"))
    hits = e.select(*GROUP, "cell", "thr", "area", F.explode(F.when(F.size(near) == 1, _fold(keyed)).otherwise(_fold(F.sort_array(keyed)))).alias("m"))
    return hits.select(*GROUP, "cell", "thr", "area", "m.*")


def _pairs(groups: DataFrame) -> DataFrame:
    """The pairs of groups in which no pair competes: each is matched wherever it reaches the threshold."""
    return groups.where("plain").select(*GROUP, F.inline("c"))


def coco_match(gt: DataFrame, predictions: DataFrame, thresholds: list[float] = IOU_THRESHOLDS, areas: tuple[str, ...] = ("all",), max_dets: int = 500) -> DataFrame:
    """One row per matched detection: the group, cell (number of thr and area), thr, area, det_ord, ann_id, ig (1: with an ignored object)."""
    groups = _candidates(gt, ranked(predictions, max_dets), min(thresholds))
    cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(t).alias("thr"), F.lit(a).alias("area"), _outside(a).cast("int").alias("ig")) for i, (t, a) in enumerate(_cells(thresholds, areas))])
    plain = _pairs(groups).select(*GROUP, "det_ord", "ann_id", "iou", F.inline(cells)).where(_reaches(F.col("iou"), F.col("thr")))
    columns = [*GROUP, "cell", "thr", "area", F.col("det_ord").cast("long").alias("det_ord"), F.col("ann_id").cast("long").alias("ann_id"), "ig"]
    return plain.select(*columns).unionByName(_folded(groups, thresholds, areas))


def matched(gt: DataFrame, predictions: DataFrame, thresholds: list[float], areas: tuple[str, ...], max_dets: int) -> DataFrame:
    """(dataset, image_id, category_id, mode, npig_<area>..., d): the judged() detections of each group as a list, and the objects that count in each area range.

    Objects and detections are judged where they stand together; they are dealt for that, by image and class, only if they
    are not dealt by image already. An image's objects are told once, beside the first of its modes, or beside none. Rows with a null among the keys meet nothing.
    """
    nothing = lambda t, *names: [F.lit(None).cast(t.schema[c].dataType).alias(c) for c in names]
    sides = [F.col(v).cast("double").alias(v) for v in BOX]
    g = with_defaults(gt)
    rows = g.select(*SAME, F.lit(True).alias("is_object"), *sides, "ann_id", F.col("area").cast("double").alias("area"), F.col("iscrowd").cast("int").alias("iscrowd"), *nothing(predictions, "mode", "score", "det_ord"))
    rows = side_by_side(rows, predictions.select(*SAME, F.lit(False).alias("is_object"), *sides, *nothing(g, "ann_id"), F.lit(None).cast("double").alias("area"), F.lit(None).cast("int").alias("iscrowd"), "mode", "score", "det_ord"))
    keys = ["_image_id", "_dataset", "_category_id"]
    # a window asks for rows of a group to stand together, in whatever way they are dealt; a repartition would deal them again
    d = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("is_object")))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    columns = [f"{c.removeprefix('_')} {kind(c)}" for c in (*keys, "mode")] + [f"npig_{a} long" for a in areas]
    schema = ", ".join([*columns, f"d array<struct<score:{kind('score')},det_ord:{kind('det_ord')},rank:int,tp:bigint,ignored:bigint>>"])
    limits = [AREAS[a] for a in areas]
    return d.mapInArrow(lambda b: judge(b, keys, thresholds, limits, max_dets), schema)


def rows_of(groups: DataFrame, *carried: str) -> DataFrame:
    """The detections of matched() as rows, with further columns of their group."""
    return groups.select(*CLASS, "image_id", *carried, F.inline("d")).select(*CLASS, "score", "image_id", "det_ord", "rank", "tp", "ignored", *carried)


def judged(gt: DataFrame, predictions: DataFrame, thresholds: list[float], areas: tuple[str, ...], max_dets: int) -> DataFrame:
    """Every detection with its rank and one bit for each cell (threshold and area range; at most 62): tp, whether it is a hit, and ignored."""
    return rows_of(matched(gt, predictions, thresholds, areas, max_dets))


def _found_by(groups: DataFrame) -> DataFrame:
    """(dataset, mode) that detect anything, of matched()."""
    return groups.where(F.size("d") > 0).select("dataset", "mode").distinct()


def _counted(groups: DataFrame, areas: tuple[str, ...]) -> DataFrame:
    """(dataset, category_id, npig_<area>...): objects that count in each area range, of matched()."""
    return groups.groupBy("dataset", "category_id").agg(*[F.sum(f"npig_{a}").alias(f"npig_{a}") for a in areas])


def coco_curves(gt: DataFrame, predictions: DataFrame, thresholds: list[float], areas: tuple[str, ...], max_dets: int, few: tuple[int, ...] = ()) -> DataFrame:
    """(dataset, mode, category_id, thr, area, npig, ap, ar, ar_<few>...) of every cell with counted objects.

    ar_<n> is the recall of the first n detections of each image and class: the first ones are matched the same whether
    others follow or not, so one matching serves all.
    """
    cells = _cells(thresholds, areas)
    groups = keep(matched(gt, predictions, thresholds, areas, max_dets), "matched")
    rows = F.array(*[F.struct(F.lit(k).alias("cell"), F.lit(t).alias("thr"), F.lit(a).alias("area"), F.col(f"npig_{a}").alias("npig")) for k, (t, a) in enumerate(cells)])
    objects = _counted(groups, areas).select("dataset", "category_id", F.inline(rows)).where("npig > 0")
    d = sorted_detections(rows_of(groups))
    sums = range_sums(d, len(cells), (max_dets, *few))
    ap = average_precisions(d, len(cells), objects.select("dataset", "category_id", "cell", F.array(F.col("npig").cast("double")).alias("npig")), sums)
    ap = ap.select(*CLASS, "cell", F.get("ap", F.lit(0)).alias("ap"))
    found = sums.groupBy(*CLASS, "cell").agg(*[F.sum(f"first_{n}").alias(f"ar_{n}") for n in (max_dets, *few)])
    full = objects.join(_found_by(groups), "dataset").join(ap, [*CLASS, "cell"], "left").join(found, [*CLASS, "cell"], "left")
    recall = lambda n: F.coalesce(F.col(f"ar_{n}"), F.lit(0)) / F.col("npig")
    return full.select(*CLASS, "thr", "area", "npig", F.coalesce("ap", F.lit(0.0)).alias("ap"), recall(max_dets).alias("ar"), *[recall(n).alias(f"ar_{n}") for n in few])


def _mean(value: str, when: Column) -> Column:
    return F.coalesce(F.avg(F.when(when, F.col(value))), F.lit(-1.0))


def coco_score_by_category(gt: DataFrame, predictions: DataFrame, max_dets: int = 500) -> DataFrame:
    """AP, AP50 and AP75 of each (dataset, mode, category_id), times 100."""
    c = coco_curves(gt, predictions, IOU_THRESHOLDS, ("all",), max_dets)
    at = lambda t: F.abs(F.col("thr") - t) < 1e-9
    return c.groupBy("dataset", "mode", "category_id").agg((100 * F.avg("ap")).alias("ap"), (100 * _mean("ap", at(0.5))).alias("ap50"), (100 * _mean("ap", at(0.75))).alias("ap75"), F.max("npig").alias("n_objects"))


def coco_score(gt: DataFrame, predictions: DataFrame, areas: tuple[str, ...] = ("all", "small", "medium", "large"), max_dets: tuple[int, ...] = (1, 10, 500)) -> DataFrame:
    """The summary of each (dataset, mode): ap, ap50, ap75, ap_<area>, ar_<max dets>, ar_<area>; -1 where nothing counts."""
    c = coco_curves(gt, predictions, IOU_THRESHOLDS, areas, max_dets[-1], max_dets[:-1])
    at = lambda t: (F.col("area") == "all") & (F.abs(F.col("thr") - t) < 1e-9)
    whole = F.col("area") == "all"
    agg = [_mean("ap", whole).alias("ap"), _mean("ap", at(0.5)).alias("ap50"), _mean("ap", at(0.75)).alias("ap75")]
    agg += [_mean("ap", F.col("area") == a).alias(f"ap_{a}") for a in areas if a != "all"] + [_mean("ar", F.col("area") == a).alias(f"ar_{a}") for a in areas if a != "all"]
    agg += [_mean("ar", whole).alias(f"ar_{max_dets[-1]}")] + [_mean(f"ar_{n}", whole).alias(f"ar_{n}") for n in max_dets[:-1]]
    return c.groupBy("dataset", "mode").agg(*agg)


def coco_recalls(gt: DataFrame, predictions: DataFrame, max_dets: tuple[int, ...]) -> DataFrame:
    """(dataset, mode, ar_<n>...): the recall of the first n detections of each image and class, for every n, from one matching."""
    few = tuple(sorted(max_dets)[:-1])
    most = max(max_dets)
    # hits of all cells together, added up inside a group's list; what is left is a row for each class, kept as it is read three times
    hits = lambda n: F.aggregate("d", F.lit(0).cast("long"), lambda a, x: F.when(x["rank"] <= n, a + F.bit_count(x["tp"])).otherwise(a))
    d = matched(gt, predictions, IOU_THRESHOLDS, ("all",), most)
    per = keep(d.groupBy(*CLASS).agg(F.sum("npig_all").alias("npig_all"), F.max(F.size("d")).alias("_most"), *[F.sum(hits(n)).alias(f"n_{n}") for n in (*few, most)]), "recalls")
    modes = per.where("_most > 0").select("dataset", "mode").distinct()
    counted = per.groupBy("dataset", "category_id").agg(F.sum("npig_all").alias("npig_all")).where("npig_all > 0").join(modes, "dataset").join(per.drop("npig_all"), CLASS, "left")
    return counted.groupBy("dataset", "mode").agg(*[F.avg(F.coalesce(F.col(f"n_{n}"), F.lit(0)) / (F.col("npig_all") * len(IOU_THRESHOLDS))).alias(f"ar_{n}") for n in max_dets])
