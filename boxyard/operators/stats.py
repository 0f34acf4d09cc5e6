"""Noise, paired differences, contrasts and bootstraps of scores.

Random draws are a documented integer hash, so that every engine draws the same: position pos of iteration it takes
element ((seed + it*7919 + pos*104729) * 48271 mod 2147483647) mod n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxyard.functions.counts import packed, unpacked
from boxyard.functions.geometry import iou
from boxyard.functions.rows import bound
from boxyard.operators import coco, curves, matching
from boxyard.operators.ranges import numbered
from boxyard.sources.tables import keep

#: Two-sided 95 % points of Student's t by number of repeats; fixed values.
T_CRITICAL = {3: 4.302652729911275, 5: 2.7764451051977987}


def draw(seed: int, it: Column, pos: Column, n: Column) -> Column:
    return ((F.lit(seed).cast("long") + it * F.lit(7919) + pos * F.lit(104729)) * F.lit(48271) % F.lit(2147483647)) % n


def paired_deltas(runs: DataFrame, baseline: str, keys: list[str], score: str = "map5095") -> DataFrame:
    """(keys, mode, delta): every other mode minus the baseline on the same keys."""
    base = runs.where(F.col("mode") == baseline).select(*keys, F.col(score).alias("base"))
    return runs.where(F.col("mode") != baseline).join(base, keys).select(*keys, "mode", (F.col(score) - F.col("base")).alias("delta"))


def repeat_noise(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """From three repeats on: mean, sd, range, the largest pair difference (the range), 1.96 sqrt(2) sd, and the tie threshold."""
    g = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("range")).where("n >= 3")
    return g.withColumn("noise95", 1.96 * F.sqrt(F.lit(2.0)) * F.col("sd")).withColumn("tie_threshold", F.greatest("range", "noise95"))


def repeat_ci(runs: DataFrame, baseline: str, score: str = "map5095", groups: tuple[str, ...] = ("dataset", "mode")) -> DataFrame:
    """Paired uplift over repeats with its 95 % interval, by dataset and mode; other numbers of repeats than 3 and 5 are an error."""
    deltas = paired_deltas(runs, baseline, [g for g in groups if g != "mode"] + ["repeat"], score)
    return _interval(deltas, list(groups))


def _interval(deltas: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, mean, sd, tie_threshold, low, high) of the column delta, a row for each repeat."""
    noise = repeat_noise(deltas, groups, "delta")
    t = F.coalesce(*[F.when(F.col("n") == k, F.lit(v)) for k, v in T_CRITICAL.items()], F.raise_error(F.concat(F.lit("no critical value for so many repeats: "), F.col("n").cast("string"))).cast("double"))
    half = t * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return noise.select(*groups, "n", "mean", "sd", "tie_threshold", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def count_contrasts(runs: DataFrame, pairs: list[tuple[str, str]], score: str = "map5095") -> DataFrame:
    """(dataset, left, right, n, mean, sd, tie_threshold, low, high): mode left minus mode right over the repeats.

    A row for each dataset and pair, and with dataset `macro` for the means over the datasets inside each repeat. A repeat that one
    of the two modes lacks in a dataset is an error there, as a contrast over other repeats would not be paired.
    """
    sides = runs.sparkSession.createDataFrame(pairs, "left string, right string").select("left", "right", F.explode(F.array(F.struct(F.col("left").alias("mode"), F.lit(1).alias("sign")), F.struct(F.col("right").alias("mode"), F.lit(-1).alias("sign")))).alias("s"))
    sides = F.broadcast(sides.select("left", "right", "s.mode", "s.sign"))  # two rows a pair
    macro = runs.groupBy("mode", "repeat").agg(F.avg(score).alias("v")).withColumn("dataset", F.lit("macro"))
    every = runs.select("dataset", "mode", "repeat", F.col(score).alias("v")).unionByName(macro)
    both = every.join(sides, "mode").groupBy("dataset", "left", "right", "repeat").agg(F.sum(F.col("sign") * F.col("v")).alias("delta"), F.count(F.lit(1)).alias("k"))
    paired = F.when(F.col("k") == 2, F.col("delta")).otherwise(F.raise_error(F.concat(F.lit("repeat without a partner in "), "dataset")).cast("double"))
    return _interval(both.withColumn("delta", paired), ["dataset", "left", "right"])


def macro_by_repeat(runs: DataFrame, score: str = "map5095") -> DataFrame:
    """Datasets are averaged inside each repeat, then the repeats are summarised: noise per mode."""
    per = runs.groupBy("mode", "repeat").agg(F.avg(score).alias("macro"))
    return repeat_noise(per, ["mode"], "macro")


def domain_macro(scores: DataFrame, domains: DataFrame, score: str = "map5095") -> DataFrame:
    """Mean score by mode and domain, and `All`; reproduced: the weighted mean of the domains is `All` within 1e-10."""
    d = scores.join(domains, "dataset")
    g = d.rollup("mode", "domain").agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("n"), F.grouping("domain").alias("_d"), F.grouping("mode").alias("_m")).where("_m = 0")
    g = g.withColumn("domain", F.when(F.col("_d") == 1, F.lit("All")).otherwise(F.col("domain"))).drop("_d", "_m")
    w = g.where("domain <> 'All'").groupBy("mode").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("weighted"))
    return g.join(w, "mode").select("mode", "domain", "score", "n", ((F.col("domain") != "All") | (F.abs(F.col("weighted") - F.col("score")) < 1e-10)).alias("reproduced"))


def label_group_gains(flags: DataFrame, gains: DataFrame) -> DataFrame:
    """Datasets by the share of flagged classes (none, some, all), and the mean gain of each group."""
    g = flags.groupBy("dataset").agg(F.avg("flag").alias("share")).select("dataset", F.when(F.col("share") == 0, "none").when(F.col("share") == 1, "all").otherwise("some").alias("label_group"))
    return gains.join(g, "dataset").groupBy("label_group", "mode").agg(F.count_distinct("dataset").alias("n_datasets"), F.avg("delta").alias("gain"))


def effects(scores: DataFrame, base: str, a: str, both: str, score: str = "map5095") -> DataFrame:
    """Per dataset: gain of a and of both over base, and both minus a."""
    wide = scores.groupBy("dataset").pivot("mode", [base, a, both]).agg(F.first(score))
    return wide.select("dataset", (F.col(a) - F.col(base)).alias("gain_a"), (F.col(both) - F.col(base)).alias("gain_both"), (F.col(both) - F.col(a)).alias("step"))


def interaction(scores: DataFrame, base: str, a: str, b: str, combined: str, score: str = "map5095") -> DataFrame:
    """Per dataset: combined - a - b + base."""
    wide = scores.groupBy("dataset").pivot("mode", [base, a, b, combined]).agg(F.first(score))
    return wide.select("dataset", (F.col(combined) - F.col(a) - F.col(b) + F.col(base)).alias("interaction"))


def flag_effect(rows: DataFrame, groups: list[str], flag: str, outcome: str) -> DataFrame:
    """Mean outcome where the flag is 1 less that where it is 0; null if a side is empty."""
    return rows.groupBy(*groups).agg((F.avg(F.when(F.col(flag) == 1, F.col(outcome))) - F.avg(F.when(F.col(flag) == 0, F.col(outcome)))).alias("effect"))


def slope_effect(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope of y on x; null where x is constant."""
    return rows.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"))


def repeatability(predictions: DataFrame, repeats: str = "mode", answers: DataFrame | None = None) -> DataFrame:
    """Over images that every repeat has: shares with the same predictions in any order, the same number, the same number by class.

    With answers (dataset, image_id, repeats, raw_response) also same_answer: the share of those images whose texts are the
    same in every repeat; a null text is a text of its own.
    """
    n_rep = predictions.select("dataset", repeats).distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rep"))
    box = F.struct("category_id", "x", "y", "w", "h", "score")
    per = predictions.groupBy("dataset", "image_id", repeats).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(box))), 256).alias("content"), F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_list("category_id"))).alias("classes"))
    img = per.groupBy("dataset", "image_id").agg(F.count(F.lit(1)).alias("seen"), *[F.count_distinct(c).alias(c) for c in ("content", "n", "classes")])
    img = img.join(n_rep, "dataset").where(F.col("seen") == F.col("n_rep"))
    share = lambda c: F.avg((F.col(c) == 1).cast("double"))
    shares = {"content": "same_content", "n": "same_count", "classes": "same_classes"}
    if answers is not None:
        text = F.coalesce(F.sha2("raw_response", 256), F.lit(""))
        told = answers.join(n_rep, "dataset").groupBy("dataset", "image_id").agg(F.count_distinct(repeats).alias("_told"), F.max("n_rep").alias("_all"), F.count_distinct(text).alias("_texts"))
        # an image without an answer in some repeat is not the same in all
        told = told.select("dataset", "image_id", F.when(F.col("_told") == F.col("_all"), F.col("_texts")).otherwise(0).alias("answer"))
        img = img.join(told, ["dataset", "image_id"], "left").na.fill(0, ["answer"])
        shares["answer"] = "same_answer"
    return img.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"), *[share(c).alias(n) for c, n in shares.items()])


def repeat_agreement(predictions: DataFrame, answers: DataFrame, threshold: float = 0.5, repeats: str = "mode") -> DataFrame:
    """How repeats of one experiment agree: a row for each dataset.

    answers: (dataset, image_id, repeats, raw_response), a row for each image of a repeat, also where nothing was found.
    n_images, n_repeats; the shares same_answer, same_content, same_count, same_classes of images that are alike in every
    repeat; over all images and pairs of repeats n_pairs, mean_f1 (1 where neither found anything), and n_matches and
    mean_iou of boxes matched one to one in a class. Repeats that cover different images are an error.
    """
    image = ["dataset", "image_id"]
    told = answers.select(*image, F.struct(F.col(repeats).alias("r"), F.unhex(F.sha2("raw_response", 256)).alias("t")).alias("a"))
    boxes = predictions.select(*image, F.struct(F.col(repeats).alias("r"), "category_id", F.col("det_ord").cast("long").alias("o"), *matching.BOX, "score").alias("p"))
    none = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    both = told.select(*image, "a", none(boxes, "p")).unionByName(boxes.select(*image, none(told, "a"), "p"))
    # an image's answers and boxes meet once, and all that is told of it is worked out in its row
    d = both.repartition(*image).groupBy(*image).agg(F.collect_list("a").alias("a"), F.collect_list("p").alias("p")).where((F.size("a") > 0) & F.col("dataset").isNotNull())
    d = bound(d, rs=F.array_sort(F.array_distinct(F.filter(F.col("a")["r"], lambda r: r.isNotNull()))), texts=F.size(F.array_distinct(F.transform("a", lambda x: F.coalesce(x["t"], F.lit(b""))))))
    d = bound(d, p=F.filter("p", lambda x: F.col("image_id").isNotNull() & F.array_contains("rs", x["r"]))).drop("a")
    d = bound(d, by=F.transform(F.array_distinct(F.col("p")["r"]), lambda r: F.struct(r.alias("r"), F.filter("p", lambda x: x["r"] == r).alias("b")))).drop("p")
    box = lambda x: F.struct(*[x[c].alias(c) for c in ("category_id", *matching.BOX, "score")])
    unlike = lambda f: F.size(F.array_distinct(F.transform("by", lambda g: f(g["b"]))))
    d = d.withColumns({"some": F.size("by"), "content": unlike(lambda b: F.to_json(F.array_sort(F.transform(b, box)))), "n": unlike(F.size), "classes": unlike(lambda b: F.to_json(F.array_sort(F.transform(b, lambda x: x["category_id"]))))})
    d = bound(d, pairs=F.flatten(F.transform("by", lambda x: F.transform(F.filter("by", lambda y: x["r"] < y["r"]), lambda y: F.struct(x["b"].alias("a"), y["b"].alias("b"))))))
    sides = lambda x: [x[v] for v in matching.BOX]

    def near(k: Column) -> Column:
        c = F.flatten(F.transform(k["a"], lambda x: F.transform(F.filter(k["b"], lambda y: x["category_id"] == y["category_id"]), lambda y: F.struct(x["category_id"].alias("k"), iou(sides(x), sides(y)).alias("iou"), x["o"].alias("l"), y["o"].alias("r")))))
        return F.struct((F.size(k["a"]) + F.size(k["b"])).alias("n"), F.filter(c, lambda x: x["iou"] >= threshold).alias("c"))

    def taken(k: Column) -> Column:
        of_class = F.transform(F.array_distinct(k["c"]["k"]), lambda q: F.transform(F.filter(k["c"], lambda x: x["k"] == q), lambda x: F.struct(x["iou"].alias("iou"), x["l"].alias("l"), x["r"].alias("r"))))
        return F.struct(k["n"].alias("n"), F.flatten(F.transform(of_class, matching.taken_pairs)).alias("m"))

    d = bound(d, met=F.transform(F.transform("pairs", near), taken))
    total = lambda f, zero: F.aggregate("met", F.lit(zero), lambda s, k: s + f(k))
    f1, n_matches = total(lambda k: 2 * F.size(k["m"]) / k["n"], 0.0), total(lambda k: F.size(k["m"]), 0)
    overlap = total(lambda k: F.aggregate(k["m"], F.lit(0.0), lambda s, x: s + x["iou"]), 0.0)
    # what images have in common is few rows
    kind = ["dataset", "rs", "texts", "some", "content", "n", "classes"]
    per = keep(d.groupBy(*kind).agg(F.count(F.lit(1)).alias("images"), F.sum(f1).alias("f1"), F.sum(n_matches).alias("n_matches"), F.sum(overlap).alias("iou")), "agreement")
    n = per.select("dataset", F.explode("rs").alias("r")).groupBy("dataset").agg(F.count_distinct("r").alias("n_repeats"))
    j = per.join(n, "dataset", "left").na.fill(0, ["n_repeats"])
    bare = F.col("n_repeats") - F.col("some")  # repeats that found nothing in the image
    share = lambda when: F.sum(F.when(when, F.col("images")).otherwise(0)) / F.sum("images")
    alike = lambda c: share(F.col(c) + (bare > 0).cast("int") == 1).alias(f"same_{c}")
    uneven = F.max((F.size("rs") != F.col("n_repeats")).cast("int")) == 1
    out = j.groupBy("dataset").agg(
        F.when(uneven, F.raise_error(F.concat(F.lit("repeats cover different images of "), F.first("dataset"))).cast("long")).otherwise(F.sum("images")).alias("n_images"), F.first("n_repeats").alias("n_repeats"),
        share(F.col("texts") == 1).alias("same_answer"), alike("content"), alike("n").alias("same_count"), alike("classes"),
        F.sum(F.col("images") * F.col("n_repeats") * (F.col("n_repeats") - 1) / 2).cast("long").alias("n_pairs"), F.sum(F.col("images") * bare * (bare - 1) / 2).alias("_bare"),
        F.sum("f1").alias("_f1"), F.sum("n_matches").alias("n_matches"), F.sum("iou").alias("_iou"),
    )
    mean = lambda v, c: v / F.nullif(F.col(c), F.lit(0))
    return out.select("dataset", "n_images", "n_repeats", "same_answer", "same_content", "same_count", "same_classes", "n_pairs", mean(F.col("_f1") + F.col("_bare"), "n_pairs").alias("mean_f1"), "n_matches", mean(F.col("_iou"), "n_matches").alias("mean_iou"))


def cluster_bootstrap(rows: DataFrame, flag: str, outcome: str, iterations: int, seed: int) -> DataFrame:
    """Interval of the flag effect when whole datasets are drawn with replacement: estimate, low, high, n_valid.

    Datasets are first reduced to sums, so an iteration works on one row per dataset.
    """
    s = rows.groupBy("dataset").agg(*[f.alias(n) for n, f in {
        "n1": F.sum(F.col(flag)), "s1": F.sum(F.when(F.col(flag) == 1, F.col(outcome)).otherwise(0.0)), "n0": F.sum(1 - F.col(flag)), "s0": F.sum(F.when(F.col(flag) == 0, F.col(outcome)).otherwise(0.0)),
    }.items()])
    listed = s.agg(F.array_sort(F.collect_list(F.struct("dataset", "n1", "s1", "n0", "s0"))).alias("all"))  # one row per dataset, bounded by their number
    its = rows.sparkSession.range(iterations).withColumnRenamed("id", "it")
    d = its.join(F.broadcast(listed)).withColumn("n", F.size("all"))
    d = d.select("it", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda p: F.get("all", draw(seed, F.col("it"), p, F.col("n")).cast("int")))).alias("x")).select("it", "x.*")
    per = d.groupBy("it").agg((F.sum("s1") / F.nullif(F.sum("n1"), F.lit(0)) - F.sum("s0") / F.nullif(F.sum("n0"), F.lit(0))).alias("effect")).where(F.col("effect").isNotNull())
    got = per.agg(F.count(F.lit(1)).alias("n_valid"), F.percentile("effect", F.lit(0.025)).alias("low"), F.percentile("effect", F.lit(0.975)).alias("high"))
    point = s.agg((F.sum("s1") / F.nullif(F.sum("n1"), F.lit(0)) - F.sum("s0") / F.nullif(F.sum("n0"), F.lit(0))).alias("estimate"))
    return point.join(got).withColumn("enough", F.col("n_valid") >= 0.95 * iterations)  # two one-row tables


def _effect(kind: Column, n: Column, x: Column, y: Column, xx: Column, xy: Column) -> Column:
    """From sums over rows: `flag`, the mean of y where x is 1 less that where it is 0, or `slope`, the least-squares slope; null where it is not defined."""
    flag = xy / F.nullif(x, F.lit(0.0)) - (y - xy) / F.nullif(n - x, F.lit(0.0))
    spread = xx - x * x / n
    # what is left of equal numbers after rounding is no spread
    slope = (xy - x * y / n) / F.when(spread > 1e-12 * F.greatest(xx, F.lit(1e-300)), spread)
    value = F.when(kind == "flag", flag).otherwise(slope)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def cluster_effects(rows: DataFrame, groups: list[str], flags: list[str], slopes: list[str], outcome: str, iterations: int, seed: int) -> DataFrame:
    """(groups, kind, field, estimate, low, high, n_valid): effects of flags and slopes on an outcome, with intervals over whole datasets.

    Rows are reduced to the sums (n, x, y, xx, xy) of each dataset, which add up whatever datasets are drawn, so a draw
    costs one row. Draws without a defined effect are left out; fewer than 95 of 100 defined ones are an error. Rows
    in which the field or the outcome is null do not count.
    """
    fields = [(k, f) for k, fs in (("flag", flags), ("slope", slopes)) for f in fs]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for k, f in fields])
    d = rows.select(*groups, "dataset", F.col(outcome).cast("double").alias("y"), F.inline(each)).where("x is not null and y is not null")
    key = [*groups, "kind", "field"]
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.count(F.lit(1)).cast("double"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y)}
    m = d.groupBy(*key, "dataset").agg(*[v.alias(c) for c, v in sums.items()])
    m = keep(m.withColumn("pos", (F.row_number().over(W.partitionBy(*key).orderBy("dataset")) - 1).cast("long")).withColumn("of", F.count(F.lit(1)).over(W.partitionBy(*key))), "moments")
    its = rows.sparkSession.range(iterations).withColumnRenamed("id", "it")
    picks = m.select(*key, "pos", "of").join(F.broadcast(its)).select(*key, "it", draw(seed, F.col("it"), F.col("pos"), F.col("of")).alias("pos")).groupBy(*key, "it", "pos").agg(F.count(F.lit(1)).alias("k"))
    total = lambda d, weight: d.agg(*[F.sum(weight * F.col(c)).alias(c) for c in sums])
    value = _effect(F.col("kind"), *[F.col(c) for c in sums]).alias("effect")
    drawn = total(picks.join(m, [*key, "pos"]).groupBy(*key, "it"), F.col("k")).select(*key, value)
    got = drawn.groupBy(*key).agg(F.count("effect").alias("n_valid"), F.percentile("effect", F.lit(0.025)).alias("low"), F.percentile("effect", F.lit(0.975)).alias("high"))
    enough = F.when(F.col("n_valid") >= 0.95 * iterations, F.col("n_valid")).otherwise(F.raise_error(F.concat(F.lit("too few draws have an effect of "), F.col("field"))).cast("long"))
    point = total(m.groupBy(*key), F.lit(1.0)).select(*key, value).withColumnRenamed("effect", "estimate")
    return point.join(got, key).select(*key, "estimate", "low", "high", enough.alias("n_valid"))


_SUMS = [f"{c}_{side}" for side in "ab" for c in "gpm"]


def _drawn_sums(t: pa.Table) -> pa.Table:
    """Of a part of a dataset: the sums of every column of _SUMS over its images, as often as each was drawn, for every sample."""
    w = unpacked(t.column("weights").to_pylist()).astype(np.int64)
    sums = {c: pa.array((w * t.column(c).to_numpy()[:, None]).sum(axis=0)) for c in _SUMS}
    n = w.shape[1]
    return pa.table({"dataset": pa.array(t.column("dataset")[:1].to_pylist() * n, pa.string()), "it": pa.array(np.arange(n) - 1)} | sums)


def image_bootstrap(per_image: DataFrame, a: str, b: str, iterations: int, seed: int) -> DataFrame:
    """Paired bootstrap over images: (dataset, it, delta) of pooled f1, both arms scored on the same drawn images.

    per_image: (dataset, mode, image_id, n_gt, n_pred, n_matched). Matching is by image, so drawing images draws matches: an
    image drawn k times counts k times. Images are numbered in the order of their ids. How often each is drawn is counted
    for all iterations at once, so no row is made for a draw; images are a small table, kept as they are read several times.
    """
    of = lambda c, m: F.coalesce(F.sum(F.when(F.col("mode") == m, F.col(c))), F.lit(0)).cast("long")
    sums = [of(c, m).alias(n) for n, (m, c) in zip(_SUMS, [(m, c) for m in (a, b) for c in ("n_gt", "n_pred", "n_matched")], strict=True)]
    w = keep(per_image.groupBy("dataset", "image_id").agg(*sums), "images")
    # an image without an id or a dataset has no place in the order and meets no draw
    w = w.where("dataset is not null and image_id is not null")
    rows = w.join(draw_weights(w, iterations, (seed,)), ["dataset", "image_id"]).withColumn("_part", F.pmod(F.xxhash64("image_id"), F.lit(256)).cast("int"))
    drawn = rows.groupBy("dataset", "_part").applyInArrow(_drawn_sums, "dataset string, it long, " + ", ".join(f"{c} long" for c in _SUMS))
    f1 = lambda side: 2 * F.sum(f"m_{side}") / F.sum(F.col(f"g_{side}") + F.col(f"p_{side}"))
    return drawn.where("it >= 0").groupBy("dataset", "it").agg((f1("b") - f1("a")).alias("delta"))


#: Images of a dataset whose draws one task counts.
_IMAGES = 1 << 17


def _counted_draws(t: pa.Table, iterations: int, seeds: tuple[int, ...]) -> pa.Table:
    """How often each image of a range of a dataset is drawn: first once, as it is, then for every seed and iteration."""
    n, places = t.column("total")[0].as_py(), t.column("pos").to_numpy()
    low, m = int(places.min()), len(t)
    out = np.zeros((int(places.max()) - low + 1, 1 + len(seeds) * iterations), np.uint16)
    out[:, 0] = 1
    for at in range(0, n, 1 << 20):
        pos = np.arange(at, min(n, at + (1 << 20)), dtype=np.int64)
        for k, (seed, it) in enumerate([(s, i) for s in seeds for i in range(iterations)], 1):
            pick = (seed + it * 7919 + pos * 104729) * 48271 % 2147483647 % n - low
            out[:, k] += np.bincount(pick[(pick >= 0) & (pick < len(out))], minlength=len(out)).astype(np.uint16)
    rows = out[places - low]
    return pa.table({"dataset": t.column("dataset"), "image_id": t.column("image_id"), "weights": pa.array([rows[i].tobytes() for i in range(m)], pa.binary())})


def _packed_draws(t: pa.Table) -> pa.Table:
    """The same with weights as packed() bytes: most images are drawn less than three times, and weights go where detections go."""
    raw = t.column("weights").to_pylist()
    rows = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)
    return t.set_column(t.column_names.index("weights"), "weights", pa.array(packed(rows), pa.binary()))


def draw_weights(images: DataFrame, iterations: int, seeds: tuple[int, ...]) -> DataFrame:
    """(dataset, image_id, weights): how often each image is drawn in each sample of its dataset, as packed() numbers.

    The first sample is the dataset itself. A sample draws as many images as the dataset has, numbered in the order of their
    ids. A task counts the draws of a bounded range of images, so no row is made for a draw.
    """
    d = numbered(images.select("dataset", "image_id").distinct(), ["dataset"], ["image_id"]).withColumn("_part", F.floor(F.col("pos") / _IMAGES).cast("long"))
    schema = f"dataset string, image_id {images.schema['image_id'].dataType.simpleString()}, weights binary"
    return d.groupBy("dataset", "_part").applyInArrow(lambda t: _packed_draws(_counted_draws(t, iterations, seeds)), schema)


def _objects_drawn(t: pa.Table) -> pa.Table:
    w = unpacked(t.column("weights").to_pylist())
    total = (w * t.column("n").to_numpy()[:, None].astype(float)).sum(axis=0)
    return pa.table({"dataset": t.column("dataset")[:1], "category_id": t.column("category_id")[:1], "part": t.column("part")[:1], "npig": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _added_up(t: pa.Table) -> pa.Table:
    total = np.array(t.column("npig").to_pylist()).sum(axis=0)
    return pa.table({"dataset": t.column("dataset")[:1], "category_id": t.column("category_id")[:1], "npig": pa.array([total.tolist()], pa.list_(pa.float64()))})


def sampled_scores(gt: DataFrame, predictions: DataFrame, images: DataFrame, iterations: int, seeds: tuple[int, ...], max_dets: int = 500) -> DataFrame:
    """(dataset, mode, seed, it, ap, ap50), times 100, of samples of whole images; seed and it are null for the dataset itself.

    Detections are matched once, since a match is inside an image. A class without an object in a sample does not count there;
    a sample without any object has the score -100. Copies of a detection stand
    at its place in the order of equal scores, which is that of image ids and of the answer's list.
    """
    weights = draw_weights(images, iterations, seeds)
    # objects are counted where detections are judged, so the tables are derived once
    groups = keep(coco.matched(gt, predictions, coco.IOU_THRESHOLDS, ("all",), max_dets).join(weights, ["dataset", "image_id"], "left"), "judged")
    drawn = groups.where("weights is not null")
    d = coco.rows_of(drawn, "weights")
    cells = len(coco.IOU_THRESHOLDS)
    g = drawn.where("npig_all > 0").withColumnRenamed("npig_all", "n")
    kind = f"dataset string, category_id {gt.schema['category_id'].dataType.simpleString()}"
    part = g.withColumn("part", F.pmod(F.xxhash64("image_id"), F.lit(64)).cast("int")).select("dataset", "category_id", "part", "n", "weights")
    npig = part.groupBy("dataset", "category_id", "part").applyInArrow(_objects_drawn, f"{kind}, part int, npig array<double>").groupBy("dataset", "category_id").applyInArrow(_added_up, f"{kind}, npig array<double>")
    objects = npig.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    # ranges are found by reading their rows twice
    ap = curves.average_precisions(curves.sorted_detections(d), cells, objects)
    # classes that a mode detects nothing of count as well
    full = objects.join(groups.where(F.size("d") > 0).select("dataset", "mode").distinct(), "dataset").join(ap, [*curves.CLASS, "cell"], "left")
    samples = F.arrays_zip("npig", F.coalesce("ap", F.array_repeat(F.lit(0.0), F.size("npig"))).alias("ap"))
    rows = full.select("dataset", "mode", "cell", F.posexplode(samples).alias("k", "x")).where("x.npig > 0")
    score = lambda when: 100 * F.coalesce(F.avg(F.when(when, F.col("x.ap"))), F.lit(-1.0))
    per = rows.groupBy("dataset", "mode", "k").agg(score(F.lit(True)).alias("ap"), score(F.col("cell") == 0).alias("ap50"))
    at = F.col("k") - 1
    return per.select("dataset", "mode", F.when(at >= 0, F.get(F.array(*[F.lit(s) for s in seeds]), F.floor(at / iterations).cast("int"))).alias("seed"), F.when(at >= 0, at % iterations).alias("it"), "ap", "ap50")


def ap_bootstrap(gt: DataFrame, predictions: DataFrame, images: DataFrame, a: str, b: str, iterations: int, seeds: tuple[int, ...], margin: float = 1.0) -> DataFrame:
    """Paired bootstrap of b against a over images: (dataset, seed, metric, point, mean, low, high, p_better, resolved, equivalent).

    metric is ap or ap50; point is the difference on the dataset itself. An interval that holds zero is no proof of
    equality: only a point difference within the margin is.
    """
    s = sampled_scores(gt, predictions.where(F.col("mode").isin(a, b)), images, iterations, seeds)
    s = s.select("dataset", "mode", "seed", "it", F.explode(F.map_from_arrays(F.array(F.lit("ap"), F.lit("ap50")), F.array("ap", "ap50"))).alias("metric", "score"))
    delta = s.groupBy("dataset", "seed", "it", "metric").agg((F.max(F.when(F.col("mode") == b, F.col("score"))) - F.max(F.when(F.col("mode") == a, F.col("score")))).alias("delta"))
    point = delta.where(F.col("it").isNull()).select("dataset", "metric", F.col("delta").alias("point"))
    got = delta.where(F.col("it").isNotNull()).groupBy("dataset", "seed", "metric").agg(
        F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("p_better")
    )
    got = got.join(point, ["dataset", "metric"])
    return got.select("dataset", "seed", "metric", "point", "mean", "low", "high", "p_better", ((F.col("low") > 0) | (F.col("high") < 0)).alias("resolved"), (F.abs("point") <= margin).alias("equivalent"))


def bootstrap_interval(draws: DataFrame) -> DataFrame:
    """(dataset, mean, low, high, p_better) of bootstrapped deltas."""
    return draws.groupBy("dataset").agg(F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("p_better"))


def equivalence_decision(intervals: DataFrame, point: str, margin: float) -> DataFrame:
    """Adds excludes_zero and practically_equal, two separate questions."""
    return intervals.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0)).withColumn("practically_equal", F.abs(F.col(point)) <= margin)
