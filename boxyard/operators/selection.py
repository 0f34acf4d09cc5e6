"""Choice of recipes and routes within noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def efficient_best(rows: DataFrame, margin: float, groups: list[str], score: str = "map5095", costs: tuple[str, ...] = ("task_count", "prompt_tokens")) -> DataFrame:
    """Within the margin of a group's best score the row of least cost (costs in turn, then the higher score, then the mode)."""
    d = rows.withColumn("_top", F.max(score).over(W.partitionBy(*groups))).where(F.col(score) >= F.col("_top") - margin)
    w = W.partitionBy(*groups).orderBy(*costs, F.desc(score), "mode")
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_top")


def finalist_choice(rows: DataFrame, thresholds: DataFrame, costs: tuple[str, ...] = ("cost",), score: str = "map5095") -> DataFrame:
    """The raw best mode by macro score, the modes tied with it on every dataset, and the cheapest of those.

    thresholds: (dataset, threshold). Result: (mode, macro, is_best, tied, chosen).
    """
    macro = rows.groupBy("mode").agg(F.avg(score).alias("macro"), *[F.sum(c).alias(c) for c in costs])
    best = macro.orderBy(F.desc("macro"), "mode").limit(1).select(F.col("mode").alias("best"))
    b = rows.join(F.broadcast(best), F.col("mode") == F.col("best")).select("dataset", F.col(score).alias("best_score"), "best")
    tied = rows.join(b, "dataset").join(thresholds, "dataset").groupBy("mode").agg(F.bool_and(F.abs(F.col(score) - F.col("best_score")) <= F.col("threshold")).alias("tied"), F.first("best").alias("best"))
    d = macro.join(tied, "mode").withColumn("is_best", F.col("mode") == F.col("best"))
    w = W.partitionBy("tied").orderBy(*costs, F.desc("macro"), "mode")
    return d.withColumn("chosen", F.col("tied") & (F.row_number().over(w) == 1)).select("mode", "macro", "is_best", "tied", "chosen")


def effort_gate(rows: DataFrame, thresholds: DataFrame, order: list[str], score: str = "map5095") -> DataFrame:
    """Levels of effort in rising order: a level passes if it gains more than max(1, threshold) on every dataset over the lowest.

    Result: (mode, macro, passed, chosen); chosen is the best passing level, brought down to the lowest level that is
    tied with it everywhere, else the lowest.
    """
    rank = F.element_at(F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))]), F.col("mode"))
    r = rows.where(F.col("mode").isin(*order)).withColumn("rank", rank)
    low = r.where(F.col("mode") == order[0]).select("dataset", F.col(score).alias("low"))
    d = r.join(low, "dataset").join(thresholds, "dataset")
    d = d.withColumn("ok", F.col(score) - F.col("low") > F.greatest(F.lit(1.0), F.col("threshold")))
    per = d.groupBy("mode", "rank").agg(F.avg(score).alias("macro"), F.bool_and("ok").alias("passed"))
    best = per.where("passed").orderBy(F.desc("macro"), "rank").limit(1).select(F.col("mode").alias("best"))
    best_rows = r.join(F.broadcast(best), F.col("mode") == F.col("best")).select("dataset", F.col(score).alias("best_score"))
    tie = d.join(best_rows, "dataset").groupBy("mode").agg(F.bool_and(F.abs(F.col(score) - F.col("best_score")) <= F.col("threshold")).alias("tied"))
    d = per.join(tie, "mode", "left").withColumn("candidate", (F.col("passed") & F.coalesce("tied", F.lit(False))) | (F.col("rank") == 0))
    w = W.orderBy(F.desc(F.coalesce("tied", F.lit(False)) & F.col("passed")), "rank")  # a row per level
    return d.withColumn("chosen", F.row_number().over(w) == 1).select("mode", "macro", "passed", "chosen")


def ranking(macro: DataFrame, threshold: float, score: str = "map5095") -> DataFrame:
    """(place, mode, score, close): modes by falling score; close: within the threshold of the winner."""
    w = W.orderBy(F.desc(score), "mode")  # one row per mode
    return macro.select(F.row_number().over(w).alias("place"), "mode", F.col(score), (F.max(score).over(W.partitionBy()) - F.col(score) <= threshold).alias("close"))


def binary_route(recalls: DataFrame, base: str, candidate: str, min_gain: float) -> DataFrame:
    """(dataset, selected_mode): the candidate if it gains min_gain in recall and loses nothing at 0.5."""
    wide = recalls.groupBy("dataset").pivot("mode", [base, candidate]).agg(F.first("recall").alias("r"), F.first("recall50").alias("r50"))
    gain, gain50 = F.col(f"{candidate}_r") - F.col(f"{base}_r"), F.col(f"{candidate}_r50") - F.col(f"{base}_r50")
    return wide.select("dataset", F.when((gain >= min_gain) & (gain50 >= 0), F.lit(candidate)).otherwise(F.lit(base)).alias("selected_mode"))


def count_route(recalls: DataFrame, ladder: list[int], min_gain: float) -> DataFrame:
    """(dataset, selected, accepted): climbs the ladder of counts, each step against the count selected so far.

    recalls: (dataset, count, recall, recall50). Datasets that lack a count of the ladder get no row; see missing_counts.
    """
    d = recalls.where(F.col("count").isin(*ladder)).groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("count", "recall", "recall50"))).alias("s")).where(F.size("s") == len(ladder))
    kind = "struct<sel:int,r:double,r50:double,accepted:array<boolean>>"

    def step(state: Column, x: Column) -> Column:
        ok = (x["recall"] - state["r"] >= min_gain) & (x["recall50"] - state["r50"] >= 0)
        pick = lambda a, b: F.when(ok, a).otherwise(b)
        return F.struct(pick(x["count"], state["sel"]).cast("int").alias("sel"), pick(x["recall"], state["r"]).alias("r"), pick(x["recall50"], state["r50"]).alias("r50"), F.concat(state["accepted"], F.array(ok)).alias("accepted")).cast(kind)

    first = F.get("s", F.lit(0))
    start = F.struct(first["count"].cast("int").alias("sel"), first["recall"].cast("double").alias("r"), first["recall50"].cast("double").alias("r50"), F.array().cast("array<boolean>").alias("accepted")).cast(kind)
    got = F.aggregate(F.slice("s", 2, len(ladder)), start, step)
    return d.select("dataset", got.alias("g")).select("dataset", F.col("g.sel").alias("selected"), F.col("g.accepted").alias("accepted"))


def missing_counts(recalls: DataFrame, ladder: list[int]) -> DataFrame:
    """(dataset, count) of the ladder that have no recall."""
    want = recalls.select("dataset").distinct().select("dataset", F.explode(F.array(*[F.lit(c) for c in ladder])).alias("count"))
    return want.join(recalls.select("dataset", "count"), ["dataset", "count"], "left_anti")


def majority_route(votes: DataFrame, priority: str) -> DataFrame:
    """(dataset, route, stable) of votes (dataset, route): the most frequent; a tie with the priority route is its own; else the smaller name."""
    c = votes.groupBy("dataset", "route").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.col("route"), F.struct(F.col("n"), (F.col("route") == priority).cast("int"), F.transform(F.split(F.col("route"), ""), lambda x: -F.ascii(x))))
    return c.groupBy("dataset").agg(best.alias("route"), (F.count(F.lit(1)) == 1).alias("stable"))


def apply_routes(routes: DataFrame, scores: DataFrame, baseline: str, score: str = "map5095") -> DataFrame:
    """(part, n_datasets, macro, baseline_macro, gain) for all datasets and, if routes has `held_out`, that part."""
    got = routes.join(scores, (routes["dataset"] == scores["dataset"]) & (routes["selected_mode"] == scores["mode"])).select(routes["dataset"], "held_out", F.col(score).alias("s"))
    base = scores.where(F.col("mode") == baseline).select("dataset", F.col(score).alias("b"))
    d = got.join(base, "dataset").select("s", "b", F.explode(F.when(F.col("held_out"), F.array(F.lit("all"), F.lit("held_out"))).otherwise(F.array(F.lit("all")))).alias("part"))
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n_datasets"), F.avg("s").alias("macro"), F.avg("b").alias("baseline_macro"), F.avg(F.col("s") - F.col("b")).alias("gain"))


def route_accuracy(routes: DataFrame, scores: DataFrame, base: str, candidate: str, score: str = "map5095") -> DataFrame:
    """Share of datasets whose route is the winner (the candidate wins only if strictly better)."""
    wide = scores.groupBy("dataset").pivot("mode", [base, candidate]).agg(F.first(score))
    d = routes.join(wide.select("dataset", F.when(F.col(candidate) > F.col(base), F.lit(candidate)).otherwise(F.lit(base)).alias("winner")), "dataset")
    return d.agg(F.count(F.lit(1)).alias("n_datasets"), F.avg((F.col("winner") == F.col("selected_mode")).cast("double")).alias("accuracy"))
