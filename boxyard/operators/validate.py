"""Checks of datasets, runs and configurations; each gives the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxyard.functions.labels import normalize_label
from boxyard.operators.tasks import large_set_sha
from boxyard.sources.tables import keep


def _rule(d: DataFrame, name: str, key: Column) -> DataFrame:
    return d.select("dataset", F.lit(name).alias("rule"), key.cast("string").alias("key"))


def validate_dataset(images: DataFrame, annotations: DataFrame, categories: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(dataset, rule, key) of violations. Boxes without area are no violation; dataset_inventory counts them."""

    def twice(d: DataFrame, c: str, name: str) -> DataFrame:
        return _rule(d.groupBy("dataset", c).count().where("count > 1"), name, F.col(c))

    sizes = images.select("dataset", "image_id", "width", "height")
    known = categories.select("dataset", "category_id").distinct()
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300) for c in ("x", "y", "w", "h")])
    placed = annotations.where(finite & (F.col("w") >= 0) & (F.col("h") >= 0)).join(sizes.dropDuplicates(["dataset", "image_id"]), ["dataset", "image_id"])
    outside = (F.col("x") < -tolerance) | (F.col("y") < -tolerance) | (F.col("x") + F.col("w") > F.col("width") + tolerance) | (F.col("y") + F.col("h") > F.col("height") + tolerance)
    norm = categories.withColumn("norm", normalize_label(F.col("name")))
    parts = [
        twice(images, "image_id", "duplicate_image"), twice(categories, "category_id", "duplicate_category"), twice(annotations, "ann_id", "duplicate_annotation"),
        _rule(norm.groupBy("dataset", "norm").count().where("count > 1"), "ambiguous_name", F.col("norm")),
        _rule(images.where("width <= 0 or height <= 0"), "image_size", F.col("image_id")),
        _rule(annotations.join(sizes, ["dataset", "image_id"], "left_anti"), "unknown_image", F.col("ann_id")),
        _rule(annotations.join(known, ["dataset", "category_id"], "left_anti"), "unknown_category", F.col("ann_id")),
        _rule(annotations.where(~finite), "bad_box", F.col("ann_id")), _rule(annotations.where(finite & ((F.col("w") < 0) | (F.col("h") < 0))), "negative_box", F.col("ann_id")),
        _rule(placed.where(outside), "outside", F.col("ann_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def dataset_inventory(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(dataset or `total`, n_images, n_classes, n_annotations, n_degenerate)."""
    i = images.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"))
    c = categories.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_classes"))
    a = annotations.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_annotations"), F.count_if((F.col("w") <= 0) | (F.col("h") <= 0)).alias("n_degenerate"))
    d = i.join(c, "dataset", "full").join(a, "dataset", "full").na.fill(0)
    cols = ("n_images", "n_classes", "n_annotations", "n_degenerate")
    return d.rollup("dataset").agg(*[F.sum(x).alias(x) for x in cols]).withColumn("dataset", F.coalesce("dataset", F.lit("total")))


def split_leakage(images: DataFrame) -> DataFrame:
    """(dataset, file_name, splits) of files that stand in several splits of a dataset."""
    d = images.groupBy("dataset", "file_name").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return d.where(F.size("splits") > 1)


def category_schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dataset, category_id, name_a, name_b) where two category tables differ."""
    x = a.select("dataset", "category_id", F.col("name").alias("name_a"))
    y = b.select("dataset", "category_id", F.col("name").alias("name_b"))
    return x.join(y, ["dataset", "category_id"], "full").where(~F.col("name_a").eqNullSafe(F.col("name_b")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dataset, file_name, change) of two inventories (dataset, file_name, sha): missing, extra or changed."""
    x = old.select("dataset", "file_name", F.col("sha").alias("old_sha"))
    d = x.join(new.select("dataset", "file_name", F.col("sha").alias("new_sha")), ["dataset", "file_name"], "full")
    change = F.when(F.col("new_sha").isNull(), "missing").when(F.col("old_sha").isNull(), "extra").when(F.col("old_sha") != F.col("new_sha"), "changed")
    return d.select("dataset", "file_name", change.alias("change")).where(F.col("change").isNotNull())


def _object_hashes(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, image_id, sha) over an image's own fields and its annotations, and (dataset, image_id, ann_id, sha) of each annotation."""
    own = lambda d, keys: F.sha2(F.to_json(F.struct(*sorted(c for c in d.columns if c not in keys)), {"ignoreNullFields": "false"}), 256)
    a = keep(annotations.select("dataset", "image_id", "ann_id", F.unhex(own(annotations, ("dataset", "image_id", "ann_id"))).alias("sha")), "hashes")  # read twice
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ann_id", "sha"))), lambda x: F.concat(x["ann_id"].cast("string"), F.lit(":"), F.hex(x["sha"])))
    per = a.groupBy("dataset", "image_id").agg(F.array_join(listed, ",").alias("_a"))
    i = images.select("dataset", "image_id", own(images, ("dataset", "image_id")).alias("_own")).join(per, ["dataset", "image_id"], "full")
    return keep(i.select("dataset", "image_id", F.sha2(F.concat_ws("|", F.coalesce("_own", F.lit("-")), F.coalesce("_a", F.lit("-"))), 256).alias("sha")), "hashes"), a


def _changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): missing, extra or changed, of two tables with a sha for each key."""
    d = old.select(*keys, F.col("sha").alias("_o")).join(new.select(*keys, F.col("sha").alias("_n")), keys, "full")
    return d.select(*keys, F.when(F.col("_n").isNull(), "missing").when(F.col("_o").isNull(), "extra").when(F.col("_o") != F.col("_n"), "changed").alias("change")).where(F.col("change").isNotNull())


def snapshot_changes(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(level, dataset, image_id, ann_id, change) of two snapshots (images, annotations): level is dataset, image or annotation.

    Every column that is not a key is part of what is compared. Hashes of annotations roll up to images and those to datasets,
    and only below what has changed on both sides is looked for what it was: equal datasets and equal images are never
    joined in detail. What is missing or extra as a whole is told once, at its own level.
    """
    (old_images, old_objects), (new_images, new_objects) = (_object_hashes(*s) for s in (old, new))
    whole = keep(_changes(large_set_sha(old_images, ["dataset"], ["image_id", "sha"]), large_set_sha(new_images, ["dataset"], ["image_id", "sha"]), ["dataset"]), "datasets")
    below = whole.where("change = 'changed'").select("dataset")
    images = keep(_changes(old_images.join(below, "dataset", "left_semi"), new_images.join(below, "dataset", "left_semi"), ["dataset", "image_id"]), "images")
    below = images.where("change = 'changed'").select("dataset", "image_id")
    key = ["dataset", "image_id"]
    objects = _changes(old_objects.join(below, key, "left_semi"), new_objects.join(below, key, "left_semi"), [*key, "ann_id"])
    row = lambda level, d: d.select(F.lit(level).alias("level"), "dataset", *[(F.col(c) if c in d.columns else F.lit(None)).cast("long").alias(c) for c in ("image_id", "ann_id")], "change")
    return row("dataset", whole).unionByName(row("image", images)).unionByName(row("annotation", objects))


def run_contract(runs: DataFrame, images: DataFrame, modes: list[str], n_datasets: int) -> DataFrame:
    """(dataset, mode, rule): number of datasets, the exact modes, and one task for each image."""
    n = images.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"))
    want = runs.select("dataset").distinct().select("dataset", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    missing = want.join(runs, ["dataset", "mode"], "left_anti").select("dataset", "mode", F.lit("missing_mode").alias("rule"))
    extra = runs.where(~F.col("mode").isin(*modes)).select("dataset", "mode", F.lit("unknown_mode").alias("rule"))
    tasks = runs.join(n, "dataset", "left").where(~F.col("task_count").eqNullSafe(F.col("n_images"))).select("dataset", "mode", F.lit("task_count").alias("rule"))
    count = runs.agg(F.count_distinct("dataset").alias("n")).where(F.col("n") != n_datasets).select(F.lit(None).cast("string").alias("dataset"), F.lit(None).cast("string").alias("mode"), F.lit("n_datasets").alias("rule"))
    return missing.unionByName(extra).unionByName(tasks).unionByName(count)


def config_drift(manifests: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, key, n_values) of configuration fields that differ inside a group; null is a value."""
    value = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("\u0000"))
    d = manifests.groupBy(group).agg(*[F.count_distinct(value(k)).alias(k) for k in keys])
    return d.select(group, F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*keys))).alias("key", "n_values")).where("n_values > 1")


def rating_contract(ratings: DataFrame, categories: DataFrame) -> DataFrame:
    """(dataset, class_name, rule): classes rated twice, not rated, or unknown."""
    r = ratings.groupBy("dataset", "class_name").agg(F.count(F.lit(1)).alias("n"))
    c = categories.select("dataset", F.col("name").alias("class_name"), F.lit(1).alias("known"))
    d = r.join(c, ["dataset", "class_name"], "full")
    rule = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "unrated").when(F.col("n") > 1, "repeated")
    return d.select("dataset", "class_name", rule.alias("rule")).where(F.col("rule").isNotNull())


def class_pair_map(categories: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (dataset, name, negative) the map (dataset, category_id, negative_id), and its violations (dataset, name, rule)."""
    c = categories.select("dataset", "name", "category_id")
    n = c.select("dataset", F.col("name").alias("negative"), F.col("category_id").alias("negative_id"))
    d = c.join(pairs, ["dataset", "name"], "full").join(n, ["dataset", "negative"], "left")
    rule = F.when(F.col("category_id").isNull(), "unknown_class").when(F.col("negative").isNull(), "unmapped").when(F.col("negative_id").isNull(), "unknown_target").when(F.col("negative_id") == F.col("category_id"), "self")
    d = d.withColumn("rule", rule)
    return d.where(F.col("rule").isNull()).select("dataset", "category_id", "negative_id"), d.where(F.col("rule").isNotNull()).select("dataset", "name", "rule")


def factorial_coverage(conditions: DataFrame, factors: list[str]) -> DataFrame:
    """(factors, rule): cells of the full cross product of the observed levels that are missing or repeated."""
    full = conditions.select(factors[0]).distinct()
    for f in factors[1:]:
        full = full.join(F.broadcast(conditions.select(f).distinct()))  # levels of an experiment's factor, a handful
    n = conditions.groupBy(*factors).agg(F.count(F.lit(1)).alias("n"))
    d = full.join(n, factors, "left")
    return d.select(*factors, F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("rule")).where(F.col("rule").isNotNull())


def subset(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose (all shared columns of) keys are listed."""
    return rows.join(keys, [c for c in keys.columns if c in rows.columns], "left_semi")


def unknown_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Listed keys that no row has."""
    return keys.join(rows, keys.columns, "left_anti")


def limit_per_mode(tasks: DataFrame, n: int, per_mode: bool = True) -> DataFrame:
    """The first n tasks (by task_ord) of each mode, or of all."""
    if not per_mode:
        return tasks.orderBy("task_ord", "mode").limit(n)
    return tasks.withColumn("_rn", F.row_number().over(W.partitionBy("mode").orderBy("task_ord"))).where(F.col("_rn") <= n).drop("_rn")


def resolve_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """(dataset, file_name, path, outcome) of annotated names against stored paths: exact, by_name (one file of that base name), missing, ambiguous; extra files have no name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    f = files.select("dataset", "path")
    exact = images.select("dataset", "file_name").join(f.withColumn("file_name", F.col("path")), ["dataset", "file_name"], "left")
    by = f.withColumn("base", base(F.col("path"))).groupBy("dataset", "base").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"))
    d = exact.withColumn("base", base(F.col("file_name"))).join(by, ["dataset", "base"], "left")
    outcome = F.when(F.col("path").isNotNull(), "exact").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("by_name")
    d = d.select("dataset", "file_name", F.when(outcome.isin("exact", "by_name"), F.coalesce("path", "only")).alias("path"), outcome.alias("outcome"))
    extra = f.join(d, ["dataset", "path"], "left_anti").select("dataset", F.lit(None).cast("string").alias("file_name"), "path", F.lit("extra").alias("outcome"))
    return d.unionByName(extra)


def expected_totals(inventory: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(measure, expected, actual) of the grand totals that are not as expected. inventory: dataset_inventory(); a missing total is null."""
    total = inventory.where("dataset = 'total'").select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.lit(n).cast("long").alias("expected"), F.col(k).cast("long").alias("actual")) for k, n in expected.items()])))
    return total.where(~F.col("expected").eqNullSafe(F.col("actual")))


def token_sums(summary: DataFrame, records: DataFrame, fields: tuple[str, ...] = ("prompt_tokens", "completion_tokens")) -> DataFrame:
    """(dataset, mode, field, told, summed) where a summary's tokens are not the sums of its records; nulls count as 0, a side that is missing is null."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    told = summary.select("dataset", "mode", *[zero(c).alias(f"told_{c}") for c in fields])
    summed = records.groupBy("dataset", "mode").agg(*[F.sum(zero(c)).alias(f"summed_{c}") for c in fields])
    each = [F.struct(F.lit(c).alias("field"), F.col(f"told_{c}").alias("told"), F.col(f"summed_{c}").alias("summed")) for c in fields]
    d = told.join(summed, ["dataset", "mode"], "full").select("dataset", "mode", F.inline(F.array(*each)))
    return d.where(~F.col("told").eqNullSafe(F.col("summed")))
