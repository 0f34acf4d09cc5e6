"""Run records: status, usage, failures, cost, and the rows that summarise a run.

A record is one attempt at a task: (task_key, mode, status, completed_at, inference_seconds, token counts). `success` and
`model_failure` end a task; `error` does not; a task without a record is pending.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("success", "model_failure")
TOKENS = ("prompt_tokens", "cached_tokens", "completion_tokens")


#: What a model failure can be called in the reports.
FAILURE_TYPES = ("timeout", "max_tokens", "invalid_response")

def token_cost(prompt: Column, cached: Column, completion: Column, prices: tuple[float, float, float] = (2.0, 0.25, 6.0)) -> Column:
    """List price per million tokens of uncached, cached and written ones; null where more is cached than sent.

    The default prices are whole numbers of quarters, so the sum is exact and the division rounds once.
    """
    p, c, o = (F.coalesce(x, F.lit(0)) for x in (prompt, cached, completion))
    return F.when(p >= c, ((p - c) * prices[0] + c * prices[1] + o * prices[2]) / 1e6)


def latest(records: DataFrame) -> DataFrame:
    """One record per task: the first that ended it, else the last one."""
    terminal = F.col("status").isin(*TERMINAL)
    when = F.unix_micros(F.col("completed_at").cast("timestamp"))
    best = F.max_by(F.struct(*records.columns), F.struct(terminal.cast("int"), F.when(terminal, -when).otherwise(when), F.when(terminal, -F.col("event_id")).otherwise(F.col("event_id"))))
    return records.groupBy("task_key").agg(best.alias("r")).select("r.*")


def progress(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """(mode or `all`, total, success, model_failure, error, pending) of tasks (task_key, mode)."""
    d = tasks.select("task_key", "mode").join(latest(records).select("task_key", "status"), "task_key", "left")
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    bad = F.count_if(F.col("status").isNotNull() & ~F.col("status").isin(*TERMINAL)).alias("error")
    out = d.rollup("mode").agg(F.count(F.lit(1)).alias("total"), is_("success"), is_("model_failure"), bad, F.count_if(F.col("status").isNull()).alias("pending"), F.grouping("mode").alias("_g"))
    return out.withColumn("mode", F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("mode"))).drop("_g")


def usage_summary(records: DataFrame) -> DataFrame:
    """Per mode: token sums with nulls as 0, number of requests, mean and total of the known seconds."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in TOKENS]
    return records.groupBy("mode").agg(F.count(F.lit(1)).alias("requests"), *sums, F.avg("inference_seconds").alias("mean_seconds"), F.sum("inference_seconds").alias("total_seconds"))


def attempt_summary(records: DataFrame) -> DataFrame:
    """Per mode: attempts, attempts per task, errors, tasks that ended after an error, attempts without token counts."""
    terminal = F.col("status").isin(*TERMINAL)
    per = records.groupBy("mode", "task_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~terminal).alias("bad"), F.count_if(terminal).alias("good"), F.count_if(F.col("prompt_tokens").isNull()).alias("unknown"))
    return per.groupBy("mode").agg(
        F.sum("n").alias("attempts"), F.avg("n").alias("attempts_per_task"), F.sum("bad").alias("errors"), F.count_if((F.col("bad") > 0) & (F.col("good") > 0)).alias("recovered"), F.sum("unknown").alias("without_usage"),
    )


def attempts_of(records: DataFrame) -> DataFrame:
    """Nested attempts (array<struct<status, usage...>>) as records of their own."""
    return records.select("task_key", "mode", F.posexplode_outer("attempts").alias("attempt", "a")).select("task_key", "mode", "attempt", "a.*")


#: What tells the kind of an error: HTTP statuses, and words in its name or text; fixed values.
STATUSES = (408, 409, 429, 500, 502, 503, 504)
RETRYABLE = ("timeout", "timed out", "connection", "rate limit", "too many requests", "internalerror.algo", "<408>", "<409>", "<429>", "<500>", "<502>", "<503>", "<504>")
REJECTED = ("data_inspection_failed", "datainspectionfailed", "data inspection failed", "input image data may contain inappropriate content")
PROVIDER = (
    "apierror", "apiconnectionerror", "apitimeouterror", "ratelimiterror", "internalservererror", "error code: 5", "http/1.1 5",
    "<408>", "<409>", "<429>", "<500>", "<502>", "<503>", "<504>", "connection reset", "connection refused", "request timed out",
)


def classify_failure(records: DataFrame) -> DataFrame:
    """Adds retryable, rejection, provider_error, rate_limited, timed_out, and final_status and failure_type.

    An error of the provider, after at least one attempt, is a model failure for scoring; others, such as local faults, stay
    errors. Where there is a column status_code, a status that is set decides before the words do.
    """
    text = F.lower(F.coalesce(F.col("error"), F.lit("")))
    has = lambda words: functools.reduce(operator.or_, [text.contains(w) for w in words])
    rejection, retryable, provider = has(REJECTED), has(RETRYABLE), has(PROVIDER)
    if "status_code" in records.columns:
        code = F.coalesce(F.col("status_code").isin(*STATUSES), F.lit(False))
        retryable = code | retryable
        provider = F.when(F.col("status_code").isNotNull(), code).otherwise(provider)
    d = records.withColumns({
        "retryable": retryable, "rejection": rejection, "provider_error": rejection | provider,
        "rate_limited": has(("rate limit", "too many requests", "<429>")), "timed_out": has(("timeout", "timed out")),
    })
    promoted = (F.col("status") == "error") & (F.coalesce(F.col("n_attempts"), F.lit(0)) > 0) & F.col("provider_error")
    kind = F.when(F.col("rejection"), F.lit("provider_content_rejection")).otherwise(F.lit("provider_request_failure"))
    return d.withColumns({"final_status": F.when(promoted, F.lit("model_failure")).otherwise(F.col("status")), "failure_type": F.when(promoted, kind)})


def completeness(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """(mode, n_tasks, n_done, complete)."""
    done = latest(records).where(F.col("status").isin(*TERMINAL)).select("task_key", F.lit(1).alias("done"))
    d = tasks.select("task_key", "mode").join(done, "task_key", "left")
    return d.groupBy("mode").agg(F.count(F.lit(1)).alias("n_tasks"), F.count("done").alias("n_done")).withColumn("complete", F.col("n_tasks") == F.col("n_done"))


def finalize_runs(tasks: DataFrame, records: DataFrame, scores: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """One row per mode: completeness, statuses, usage of the records that count, attempts a task, and the score only if complete.

    With predictions (mode, ...) their number; where records have a failure_type, a map from each type to how many tasks ended with it.
    """
    last = latest(records).where(F.col("status").isin(*TERMINAL))
    status = progress(tasks, records).where("mode <> 'all'").withColumn("errors", F.col("error") + F.col("pending")).drop("error", "pending")
    d = status.join(completeness(tasks, records).select("mode", "complete"), "mode").join(usage_summary(last), "mode", "left").join(scores, "mode", "left")
    calls = records.groupBy("mode").agg(F.count(F.lit(1)).alias("_calls"))
    d = d.join(calls, "mode", "left").withColumn("calls_per_task", F.coalesce("_calls", F.lit(0)) / F.col("total")).drop("_calls")
    if predictions is not None:
        d = d.join(predictions.groupBy("mode").agg(F.count(F.lit(1)).alias("n_predictions")), "mode", "left").na.fill(0, ["n_predictions"])
    if "failure_type" in records.columns:
        kinds = last.where(F.col("failure_type").isNotNull()).groupBy("mode", "failure_type").agg(F.count(F.lit(1)).alias("n"))
        d = d.join(kinds.groupBy("mode").agg(F.map_from_entries(F.collect_list(F.struct("failure_type", "n"))).alias("failure_types")), "mode", "left")
    return d.withColumn("map5095", F.when(F.col("complete"), F.col("map5095")))


def diagnostics_summary(diagnostics: DataFrame) -> DataFrame:
    """Sums of a parser's counters by dataset; ignored labels are counted."""
    counters = [c for c, t in diagnostics.dtypes if t in ("int", "bigint") and c not in ("image_id",)]
    agg = [F.sum(c).alias(c) for c in counters]
    if "ignored_labels" in diagnostics.columns:
        agg.append(F.sum(F.size("ignored_labels")).alias("n_ignored_labels"))
    return diagnostics.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"), *agg)


def macro_summary(scores: DataFrame) -> DataFrame:
    """Per mode: number of datasets, unweighted means of the scores, sums of tokens, and cost."""
    cost = token_cost(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens"))
    return scores.groupBy("mode").agg(F.count(F.lit(1)).alias("n_datasets"), F.avg("map5095").alias("map5095"), F.avg("map50").alias("map50"), *[F.sum(c).alias(c) for c in TOKENS], F.sum(cost).alias("cost"))


def selected_reference_usage(records: DataFrame) -> DataFrame:
    """From a map class -> number of references: per class the total, images that chose any, and the mean over images."""
    n = records.select("image_id").distinct()
    d = records.select("image_id", F.explode_outer("selected").alias("class_name", "n"))
    per = d.where(F.col("n") > 0).groupBy("class_name").agg(F.sum("n").alias("total"), F.count_distinct("image_id").alias("n_images"))
    return per.join(n.agg(F.count(F.lit(1)).alias("all_images"))).withColumn("per_image", F.col("total") / F.col("all_images"))


def adaptive_summary(outcomes: DataFrame, tasks: DataFrame, categories: DataFrame) -> DataFrame:
    """(measure, name, value) of a run that chose its references: counts of its tasks and what they chose.

    outcomes: (task_key, status, failure_type, stop_reason, n_references, counts map<category_id, n>), a row for each task
    that began; tasks: (task_key); categories: (category_id). Measures `status` (with missing), `failure_type`, `stop_reason`,
    `references` of each class, also of those that nobody chose, and `total`: tasks, references, references per image and per
    class and image, and zero_shot_images, the tasks that ended without any reference.
    """
    o = tasks.select("task_key").distinct().join(outcomes, "task_key", "left")
    counted = lambda name, value, when: o.where(when).groupBy(value.alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("measure"), "name", "value")
    chosen = o.select(F.explode("counts").alias("category_id", "n")).groupBy("category_id").agg(F.sum("n").alias("n"))
    per_class = categories.select("category_id").distinct().join(chosen, "category_id", "left")
    totals = o.agg(F.count(F.lit(1)).cast("double").alias("tasks"), F.coalesce(F.sum("n_references"), F.lit(0)).cast("double").alias("references"), F.count_if((F.col("n_references") == 0) & ~F.col("status").isin("in_progress")).cast("double").alias("zero_shot_images"))
    totals = totals.join(F.broadcast(categories.agg(F.count_distinct("category_id").alias("_c"))))  # two rows
    per_image = F.col("references") / F.nullif(F.col("tasks"), F.lit(0.0))
    totals = totals.withColumns({"references_per_image": per_image, "references_per_class_image": per_image / F.nullif(F.col("_c"), F.lit(0))})
    names = ("tasks", "references", "zero_shot_images", "references_per_image", "references_per_class_image")
    flat = totals.select(F.lit("total").alias("measure"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))
    return (
        counted("status", F.coalesce("status", F.lit("missing")), F.lit(True)).unionByName(counted("failure_type", F.col("failure_type"), F.col("failure_type").isNotNull()))
        .unionByName(counted("stop_reason", F.col("stop_reason"), F.col("stop_reason").isNotNull())).unionByName(flat)
        .unionByName(per_class.select(F.lit("references").alias("measure"), F.col("category_id").cast("string").alias("name"), F.coalesce("n", F.lit(0)).cast("double").alias("value")))
    )


def normalize_run_rows(sources: list[DataFrame], image_counts: DataFrame) -> DataFrame:
    """Summaries of different shapes as one table: tokens per image and effective seconds (mean_seconds times calls_per_image)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    d = out.join(image_counts, "dataset")
    calls = F.coalesce(F.col("calls_per_image"), F.lit(1.0))
    return d.select("dataset", "mode", "map5095", ((F.col("prompt_tokens") + F.col("completion_tokens")) / F.col("n_images")).alias("tokens_per_image"), (F.col("mean_seconds") * calls).alias("seconds_per_image"))


def attempt_rate(log: DataFrame, account: str, period_seconds: int, max_calls: int) -> DataFrame:
    """For each call the number of calls of its account in the period that ends with it, and whether that is over the limit."""
    from pyspark.sql import Window as W

    ts = F.unix_micros(F.col("completed_at").cast("timestamp"))
    w = W.partitionBy(account).orderBy(ts).rangeBetween(-period_seconds * 1_000_000, 0)
    return log.withColumn("calls", F.count(F.lit(1)).over(w)).withColumn("over_limit", F.col("calls") > max_calls)


def failure_counts(records: DataFrame, known: tuple[str, ...] = FAILURE_TYPES) -> DataFrame:
    """(dataset, n_completed, n_success, n_error, n_model_failure, n_timeout, n_max_tokens, n_invalid_response, n_other_failure).

    records: (dataset, status, failure_type). Completed are successes and model failures; only the latter have a failure type.
    """
    failed = F.col("status") == "model_failure"
    each = [F.count_if(failed & (F.col("failure_type") == k)).alias(f"n_{k}") for k in known]
    other = F.count_if(failed & ~F.coalesce(F.col("failure_type").isin(*known), F.lit(False))).alias("n_other_failure")
    return records.groupBy("dataset").agg(F.count_if(failed | (F.col("status") == "success")).alias("n_completed"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if(failed).alias("n_model_failure"), *each, other)


def candidate_rows(rows: DataFrame, image_counts: DataFrame, datasets: list[str], structure: list[str]) -> DataFrame:
    """One row for each mode over the given datasets: what they share, the scores of each, means of scores, tokens and seconds per image, sums of failures.

    rows: (dataset, mode, structure, map5095, map50, prompt_tokens, completion_tokens, reasoning_tokens, total_seconds, model_failures, errors).
    A mode that a dataset lacks or has twice, and a mode whose structure differs between datasets, are errors.
    """
    d = rows.where(F.col("dataset").isin(*datasets)).join(image_counts, "dataset")
    per_image = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)) / F.col("n_images"))
    own = [F.max(F.when(F.col("dataset") == x, F.col(c))).alias(f"{x}_{c}") for x in datasets for c in ("map5095", "map50")]
    g = d.groupBy("mode").agg(
        *[F.min(c).alias(c) for c in structure], F.count(F.lit(1)).alias("_n"), F.count_distinct("dataset").alias("_d"), F.min(F.struct(*structure)).alias("_low"), F.max(F.struct(*structure)).alias("_high"), *own,
        F.avg("map5095").alias("macro_map5095"), F.avg("map50").alias("macro_map50"), per_image("prompt_tokens").alias("prompt_tokens_per_image"), per_image("completion_tokens").alias("completion_tokens_per_image"),
        per_image("reasoning_tokens").alias("reasoning_tokens_per_image"), per_image("total_seconds").alias("seconds_per_image"), F.sum("model_failures").alias("model_failures"), F.sum("errors").alias("errors"),
    )
    complete = (F.col("_n") == len(datasets)) & (F.col("_d") == len(datasets))
    mode = F.when(~complete, F.raise_error(F.concat(F.lit("modes of the datasets differ: "), "mode"))).when(~F.col("_low").eqNullSafe(F.col("_high")), F.raise_error(F.concat(F.lit("structure differs between datasets: "), "mode"))).otherwise(F.col("mode"))
    return g.withColumn("mode", mode).withColumn("total_tokens_per_image", F.col("prompt_tokens_per_image") + F.col("completion_tokens_per_image")).drop("_n", "_d", "_low", "_high")
