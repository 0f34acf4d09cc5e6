"""Choice of reference examples from labelled boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxyard.sources.tables import keep

CLASS = ["dataset", "category_id"]


def best_per_image(annotations: DataFrame) -> DataFrame:
    """The largest box of each class and image; ties go to the smaller id."""
    best = F.min_by(F.struct("ann_id", "x", "y", "w", "h"), F.struct(-(F.col("w") * F.col("h")), F.col("ann_id")))
    return annotations.groupBy("dataset", "category_id", "image_id").agg(best.alias("b")).select("dataset", "category_id", "image_id", "b.*")


def first_reference(with_area: DataFrame, strategy: str = "largest") -> DataFrame:
    """Rank 1 of each class by relative area: the largest (ties: file name, id) or the lower median. with_area has rel_area, file_name."""
    order = [F.desc("rel_area"), "file_name", "ann_id"] if strategy == "largest" else ["rel_area", "file_name", "ann_id"]
    w = W.partitionBy(*CLASS)
    d = with_area.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    place = F.lit(1) if strategy == "largest" else F.floor((F.col("_n") - 1) / 2) + 1
    return d.where(F.col("_rn") == place).drop("_rn", "_n")


def seeded_random_references(with_area: DataFrame, k: int, seed: int) -> DataFrame:
    """k references per class: the largest, then the others by a hash of seed, dataset, class and id; longer lists begin with shorter ones."""
    key = F.sha2(F.concat_ws("\u0000", F.lit(str(seed)), "dataset", F.col("category_id").cast("string"), F.col("ann_id").cast("string")), 256)
    # the first one is found by aggregation, a row for each class, and meets the boxes where they are
    rel = F.col("rel_area")  # falling: numbers that are none first, nulls last
    best = F.struct(rel.isNull().cast("int"), (~F.isnan(rel)).cast("int"), -rel, "file_name", "ann_id")
    top = with_area.groupBy(*CLASS).agg(F.min_by(F.struct("ann_id"), best).alias("_t")).select(*CLASS, F.col("_t.ann_id").alias("_top"))
    d = with_area.join(F.broadcast(top), CLASS)
    w = W.partitionBy(*CLASS).orderBy((F.col("ann_id") != F.col("_top")).cast("int"), key, "ann_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_top")


def farthest_points(vectors: np.ndarray, first: int, k: int, allowed: np.ndarray | None = None) -> list[int]:
    """Indexes in farthest-point order: each next one has the largest least squared distance to those taken; ties: the smaller index."""
    chosen, near = [first], ((vectors - vectors[first]) ** 2).sum(axis=1)
    open_ = np.ones(len(vectors), bool) if allowed is None else allowed.copy()
    open_[first] = False
    while len(chosen) < k and open_.any():
        i = int(np.argmax(np.where(open_, near, -1.0)))
        chosen.append(i)
        open_[i] = False
        near = np.minimum(near, ((vectors - vectors[i]) ** 2).sum(axis=1))
    return chosen


def diverse_references(features: DataFrame, k: int, group: str = "label", distinct: str | None = None) -> DataFrame:
    """k diverse examples per class from (group, item_id, vector): starts with the least id, then farthest_points() of the class.

    distinct: a column (the image) of which every value is used once before any is used again. Each round is one pass over
    all candidates with a partial aggregate; what it joins is a row for each class, the vectors taken so far.
    """
    f = features.select(F.col(group).alias("g"), "item_id", F.col("vector").cast("array<double>").alias("v"), F.lit(True).alias("first"))
    if distinct is not None:
        ids = features.groupBy(group, distinct).agg(F.min("item_id").alias("_least")).select(F.col(group).alias("_g"), F.col("_least"))
        f = f.drop("first").join(ids, F.col("g").eqNullSafe(F.col("_g")) & (F.col("item_id") == F.col("_least")), "left").withColumn("first", F.col("_least").isNotNull()).drop("_g", "_least")
    taken = f.groupBy("g").agg(F.min_by("v", "item_id").alias("v"), F.min("item_id").alias("item_id"))
    taken = keep(taken.select("g", F.array("item_id").alias("ids"), F.array("v").alias("vs")), "references")
    for _ in range(k - 1):
        t = taken.withColumnRenamed("g", "_g")
        d = f.join(t, F.col("g").eqNullSafe(F.col("_g"))).where(~F.array_contains("ids", F.col("item_id")))
        square = lambda p: F.aggregate(F.zip_with(F.col("v"), p, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        near = F.array_min(F.transform("vs", square))
        best = d.groupBy("g").agg(F.max_by(F.struct("item_id", "v"), F.struct("first", near.alias("near"), -F.col("item_id"))).alias("b")).withColumnRenamed("g", "_g")
        more = taken.join(best, F.col("g").eqNullSafe(F.col("_g")), "left")
        add = lambda c, x: F.when(F.col("b").isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.array(x))).alias(c)
        taken = keep(more.select("g", add("ids", F.col("b.item_id")), add("vs", F.col("b.v"))), "references")
    return taken.select(F.col("g").alias(group), F.posexplode("ids").alias("pos", "item_id")).select(group, "item_id", (F.col("pos") + 1).alias("rank"))


def class_reference_images(with_area: DataFrame) -> DataFrame:
    """For each class the image with its relatively largest box, and the ids of all its boxes of that class in order."""
    top = first_reference(with_area).select(*CLASS, "image_id", "file_name")
    boxes = with_area.select(*CLASS, "image_id", "ann_id")
    return top.join(boxes, [*CLASS, "image_id"]).groupBy(*CLASS, "image_id", "file_name").agg(F.array_sort(F.collect_list("ann_id")).alias("ann_ids"))


def _greedy_cover(pdf: pd.DataFrame, n: int) -> list:
    """Image ids by greedy cover: most new classes, then the rarer ones (sum of count / (1 + total so far)), then more objects, then the smaller id."""
    wide = pdf.pivot_table(index="image_id", columns="category_id", values="n", aggfunc="sum", fill_value=0).sort_index()
    counts, ids = wide.to_numpy(np.float64), wide.index.to_numpy()
    total, open_, got = np.zeros(counts.shape[1]), np.ones(len(ids), bool), []
    while len(got) < n and open_.any():
        fresh = ((counts > 0) & (total == 0)).sum(axis=1)
        rare = (counts / (1 + total)).sum(axis=1)
        order = np.lexsort((ids, -counts.sum(axis=1), -rare, -fresh, ~open_))
        i = order[0]
        got.append(ids[i])
        open_[i] = False
        total += counts[i]
    return sorted(got)


def stratified_subset(annotations: DataFrame, n: int) -> DataFrame:
    """(dataset, image_id) of n images per dataset that cover its classes, chosen as _greedy_cover() does.

    An image's counts by class are one row. Each round is one pass over these rows with a partial aggregate; what it joins is
    a row for each dataset: the images taken so far and the totals of its classes.
    """
    per = annotations.groupBy("dataset", "image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    per = keep(per.groupBy("dataset", "image_id").agg(F.array_sort(F.collect_list(F.struct("category_id", F.col("n").cast("double").alias("n")))).alias("counts"), F.sum("n").alias("objects")), "counts")
    totals = per.select("dataset", F.explode("counts").alias("c")).select("dataset", "c.category_id").distinct().groupBy("dataset")
    state = keep(totals.agg(F.map_from_entries(F.collect_list(F.struct("category_id", F.lit(0.0).alias("t")))).alias("totals")).withColumn("ids", F.array().cast("array<bigint>")), "subset")
    for _ in range(n):
        d = per.join(state, "dataset").where(~F.array_contains("ids", F.col("image_id").cast("long")))
        so_far = lambda c: F.element_at("totals", c["category_id"])
        fresh = F.size(F.filter("counts", lambda c: so_far(c) == 0))
        rare = F.aggregate("counts", F.lit(0.0), lambda s, c: s + c["n"] / (1 + so_far(c)))
        best = d.groupBy("dataset").agg(F.max_by(F.struct(F.col("image_id").cast("long").alias("image_id"), "counts"), F.struct(fresh.alias("fresh"), rare.alias("rare"), "objects", -F.col("image_id"))).alias("b"))
        counts = F.map_from_entries("b.counts")
        more = F.transform_values("totals", lambda c, t: t + F.coalesce(F.element_at(counts, c), F.lit(0.0)))
        some = F.col("b").isNotNull()
        d = state.join(best, "dataset", "left").select("dataset", F.when(some, more).otherwise(F.col("totals")).alias("totals"), F.when(some, F.concat("ids", F.array("b.image_id"))).otherwise(F.col("ids")).alias("ids"))
        state = keep(d, "subset")
    return state.select("dataset", F.explode("ids").alias("image_id"))


def uncovered_classes(subset: DataFrame, annotations: DataFrame) -> DataFrame:
    """(dataset, category_id) of classes that no chosen image has."""
    have = annotations.join(subset, ["dataset", "image_id"], "left_semi").select(*CLASS).distinct()
    return annotations.select(*CLASS).distinct().join(have, CLASS, "left_anti")


def leave_image_out_references(references: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """For each target image the first k references of each class that are not from it, ranked anew. references: (dataset, category_id, rank, ann_id, image_id)."""
    t = images.select("dataset", F.col("image_id").alias("target_id"))
    d = references.join(t, "dataset").where("image_id <> target_id")
    w = W.partitionBy("dataset", "target_id", "category_id").orderBy("rank")
    return d.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).select("dataset", "target_id", "category_id", "new_rank", "ann_id", "image_id")


def empty_reference_classes(references: DataFrame, images: DataFrame) -> DataFrame:
    """(dataset, target_id, category_id) of classes all of whose references are from the target image: leave-image-out leaves them empty.

    Such a class has references from one image alone, so only that image is looked for; no pair of image and reference is made.
    """
    one = references.groupBy(*CLASS).agg(F.min("image_id").alias("target_id"), F.max("image_id").alias("_last")).where(F.col("target_id") == F.col("_last"))
    targets = images.select("dataset", F.col("image_id").alias("target_id"))
    return one.join(targets, ["dataset", "target_id"]).select("dataset", "target_id", "category_id")


def calibration_split(train: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations on images that no rank-1 reference uses, (dataset, category_id, n_left) of all classes)."""
    used = references.where("rank = 1").select("dataset", "image_id").distinct()
    left = train.join(used, ["dataset", "image_id"], "left_anti")
    n = left.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n_left"))
    return left, train.select(*CLASS).distinct().join(n, CLASS, "left").na.fill(0, ["n_left"])


def reference_transmissions(images: DataFrame, references: DataFrame) -> DataFrame:
    """Per dataset: images, references, distinct reference images, and references sent if every request carries all."""
    i = images.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"))
    r = references.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("image_id").alias("n_reference_images"))
    return i.join(r, "dataset").withColumn("sent", F.col("n_images") * F.col("n_references"))


def selector_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per dataset: how many rank-1 references two selectors choose differently, and the median relative area under each."""
    x = a.select(*CLASS, F.col("ann_id").alias("ann_a"), F.col("rel_area").alias("area_a"))
    y = b.select(*CLASS, F.col("ann_id").alias("ann_b"), F.col("rel_area").alias("area_b"))
    d = x.join(y, CLASS)
    return d.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_classes"), F.count_if(F.col("ann_a") != F.col("ann_b")).alias("n_changed"), F.percentile("area_a", F.lit(0.5)).alias("median_a"), F.percentile("area_b", F.lit(0.5)).alias("median_b"))
