"""Registered queries: runs, statistics, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxyard.functions.fixtures import load, oracle
from boxyard.operators import coco, matching, runs, selection, stats
from boxyard.plans.box_queries import _F1, iou_sql, rounded
from boxyard.plans.catalog import register

_COST = "((prompt_tokens - cached_tokens) * 2.0::double + cached_tokens * 0.25::double + completion_tokens * 6.0::double) / 1e6"
_LAST = """last as (select * from (select *, row_number() over (partition by task_key order by case when status in ('success', 'model_failure') then 0 else 1 end,
   case when status in ('success', 'model_failure') then epoch_us(completed_at) else -epoch_us(completed_at) end, case when status in ('success', 'model_failure') then event_id else -event_id end) as rn from task_log) where rn = 1),
tasks as (select distinct task_key, mode from task_log union all select distinct concat(task_key, '_next'), mode from task_log where event_id % 7 = 0)"""


def tasks_of(t):
    """Tasks of the log, and some that have no record yet."""
    log = t["task_log"]
    return log.select("task_key", "mode").distinct().unionByName(log.where("event_id % 7 = 0").select(F.concat("task_key", F.lit("_next")).alias("task_key"), "mode").distinct())


@register("p9_token_cost", oracle(f"select dataset, mode, repeat, {_COST} as cost from run_scores where prompt_tokens >= cached_tokens", "run_scores"))
def p9_token_cost(spark, sf_dir):
    r = load(spark, sf_dir)["run_scores"]
    d = r.select("dataset", "mode", "repeat", runs.token_cost(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens")).alias("cost"))
    return d.where(F.col("cost").isNotNull())


@register(
    "a1_progress",
    oracle(
        f"with {_LAST}, j as (select t.mode, l.status from tasks t left join last l using (task_key)) "
        "select coalesce(mode, 'all') as mode, count(*) as total, count(*) filter (where status = 'success') as success, count(*) filter (where status = 'model_failure') as model_failure, "
        "count(*) filter (where status not in ('success', 'model_failure')) as error, count(*) filter (where status is null) as pending from j group by rollup (mode)",
        "task_log",
    ),
)
def a1_progress(spark, sf_dir):
    t = load(spark, sf_dir)
    return runs.progress(tasks_of(t), t["task_log"])


@register(
    "a2_usage_summary",
    oracle("select mode, count(*) as requests, cast(sum(coalesce(prompt_tokens, 0)) as bigint) as prompt_tokens, cast(sum(coalesce(cached_tokens, 0)) as bigint) as cached_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, round(avg(inference_seconds), 6) as mean_seconds, round(sum(inference_seconds), 4) as total_seconds from task_log group by mode", "task_log"),
)
def a2_usage_summary(spark, sf_dir):
    return rounded(runs.usage_summary(load(spark, sf_dir)["task_log"])).withColumn("total_seconds", F.round("total_seconds", 4))


@register(
    "a21_attempt_summary",
    oracle(
        "with per as (select mode, task_key, count(*) as n, count(*) filter (where status = 'error') as bad, count(*) filter (where status <> 'error') as good, count(*) filter (where prompt_tokens is null) as unknown from task_log group by all) "
        "select mode, cast(sum(n) as bigint) as attempts, round(avg(n), 6) as attempts_per_task, cast(sum(bad) as bigint) as errors, count(*) filter (where bad > 0 and good > 0) as recovered, cast(sum(unknown) as bigint) as without_usage from per group by mode",
        "task_log",
    ),
)
def a21_attempt_summary(spark, sf_dir):
    return rounded(runs.attempt_summary(load(spark, sf_dir)["task_log"]))


@register(
    "v8_completeness",
    oracle(f"with {_LAST} select t.mode, count(*) as n_tasks, count(l.task_key) as n_done, count(*) = count(l.task_key) as complete from tasks t left join (select * from last where status in ('success', 'model_failure')) l using (task_key) group by t.mode", "task_log"),
)
def v8_completeness(spark, sf_dir):
    t = load(spark, sf_dir)
    return runs.completeness(tasks_of(t), t["task_log"])


@register(
    "a3_finalize_runs",
    oracle(
        f"""with {_LAST}, fin as (select * from last where status in ('success', 'model_failure')),
p as (select t.mode, count(*) as total, count(*) filter (where l.status = 'success') as success, count(*) filter (where l.status = 'model_failure') as model_failure,
        count(*) filter (where l.status is null or l.status = 'error') as errors from tasks t left join last l using (task_key) group by t.mode),
u as (select mode, count(*) as requests, cast(sum(coalesce(prompt_tokens, 0)) as bigint) as prompt_tokens, cast(sum(coalesce(cached_tokens, 0)) as bigint) as cached_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens,
        round(avg(inference_seconds), 6) as mean_seconds, round(sum(inference_seconds), 4) as total_seconds from fin group by mode),
s as (select mode, avg(map5095) as map5095 from mode_scores group by mode), q as (select mode, count(*) as n_predictions from det_predictions group by mode), c as (select mode, count(*) as attempts from task_log group by mode)
select p.mode, round(attempts / total::double, 6) as calls_per_task, n_predictions, total, success, model_failure, errors, errors = 0 as complete, requests, prompt_tokens, cached_tokens, completion_tokens, mean_seconds, total_seconds, case when errors = 0 then round(map5095, 6) end as map5095
from p left join u using (mode) left join s using (mode) left join q using (mode) left join c using (mode)""",
        "task_log", "run_scores", "mode_scores", "det_images", "det_annotations", "det_predictions",
    ),
)
def a3_finalize_runs(spark, sf_dir):
    t = load(spark, sf_dir)
    s = t["mode_scores"].groupBy("mode").agg(F.avg("map5095").alias("map5095"))
    return rounded(runs.finalize_runs(tasks_of(t), t["task_log"], s, t["det_predictions"])).withColumn("total_seconds", F.round("total_seconds", 4))


@register(
    "a5_macro_summary",
    oracle(f"select mode, count(*) as n_datasets, round(avg(map5095), 6) as map5095, round(avg(map50), 6) as map50, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(cached_tokens) as bigint) as cached_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, round(sum({_COST}), 4) as cost from mode_scores group by mode", "run_scores", "mode_scores"),
)
def a5_macro_summary(spark, sf_dir):
    t = load(spark, sf_dir)
    d = runs.macro_summary(t["mode_scores"])
    return rounded(d).withColumn("cost", F.round("cost", 4)).withColumns({c: F.col(c).cast("long") for c in runs.TOKENS})


@register(
    "p11_classify_failure",
    oracle(
        """with e as (select event_id, case when event_type = 'error' then 'error' else 'success' end as status, event_id % 7 as k, event_id % 3 as n_attempts from events),
f as (select *, status = 'error' and n_attempts > 0 and k in (0, 1, 2, 5) as promoted from e)
select event_id, promoted, k in (0, 1, 5) as retryable, k = 2 as rejection, k = 0 as rate_limited, k = 1 as timed_out, case when promoted then 'model_failure' else status end as final_status,
       case when promoted and k = 2 then 'provider_content_rejection' when promoted then 'provider_request_failure' end as failure_type from f""",
    ),
)
def p11_classify_failure(spark, sf_dir):
    e = load(spark, sf_dir)["events"]
    said = ("RateLimitError: <429> Too Many Requests", "Request timed out", "400 DataInspectionFailed", "disk full", "1500 tokens of a capital", "Connection reset by peer", None)
    text = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 7 + 1).cast("int"))
    r = e.select("event_id", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), text.alias("error"), (F.col("event_id") % 3).alias("n_attempts"))
    d = runs.classify_failure(r)
    return d.select("event_id", (F.col("failure_type").isNotNull()).alias("promoted"), "retryable", "rejection", "rate_limited", "timed_out", "final_status", "failure_type")


@register(
    "a20_normalize_run_rows",
    oracle(
        """with n as (select dataset, count(*) as n_images from det_images group by dataset)
select s.dataset, s.mode, round(map5095, 6) as map5095, round((prompt_tokens + completion_tokens) / n_images::double, 6) as tokens_per_image, round(case when s.mode = 'ten' then map50 * 3 else map50 end, 6) as seconds_per_image from mode_scores s join n using (dataset)""",
        "det_images", "run_scores", "mode_scores",
    ),
)
def a20_normalize_run_rows(spark, sf_dir):
    t = load(spark, sf_dir)
    s = t["mode_scores"].select("dataset", "mode", "map5095", "prompt_tokens", "completion_tokens", F.col("map50").alias("mean_seconds"))
    single = s.where("mode <> 'ten'")
    many = s.where("mode = 'ten'").withColumn("calls_per_image", F.lit(3.0))
    return rounded(runs.normalize_run_rows([single, many], t["det_images"].groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"))))


@register(
    "a17_selected_reference_usage",
    oracle(
        """with c as (select image_id, cast(category_id as string) as class_name, count(*) as n from det_annotations group by all),
per as (select class_name, sum(n) as total, count(distinct image_id) as n_images from c group by class_name)
select class_name, cast(total as bigint) as total, n_images, (select count(distinct image_id) from c) as all_images, round(total / (select count(distinct image_id) from c)::double, 6) as per_image from per""",
        "det_images", "det_annotations",
    ),
)
def a17_selected_reference_usage(spark, sf_dir):
    a = load(spark, sf_dir)["det_annotations"]
    per = a.groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("category_id").cast("string"), "n"))).alias("selected"))
    return rounded(runs.selected_reference_usage(maps))


@register(
    "j7_paired_deltas",
    oracle("select a.dataset, a.repeat, a.mode, round(a.map5095 - b.map5095, 6) as delta from run_scores a join run_scores b on a.dataset = b.dataset and a.repeat = b.repeat and b.mode = 'names' where a.mode <> 'names'", "run_scores"),
)
def j7_paired_deltas(spark, sf_dir):
    return rounded(stats.paired_deltas(load(spark, sf_dir)["run_scores"], "names", ["dataset", "repeat"]))


_NOISE = "count(*) as n, avg(v) as mean, stddev_samp(v) as sd, max(v) - min(v) as range"


@register(
    "a10_repeat_noise",
    oracle(f"with n as (select dataset, mode, {_NOISE} from (select dataset, mode, map5095 as v from run_scores) group by all having count(*) >= 3) select dataset, mode, n, round(mean, 6) as mean, round(sd, 6) as sd, round(range, 6) as range, round(1.96 * sqrt(2.0) * sd, 6) as noise95, round(greatest(range, 1.96 * sqrt(2.0) * sd), 6) as tie_threshold from n", "run_scores"),
)
def a10_repeat_noise(spark, sf_dir):
    return rounded(stats.repeat_noise(load(spark, sf_dir)["run_scores"], ["dataset", "mode"], "map5095"))


@register(
    "a11_repeat_ci",
    oracle(
        f"""with d as (select a.dataset, a.mode, a.map5095 - b.map5095 as v from run_scores a join run_scores b on a.dataset = b.dataset and a.repeat = b.repeat and b.mode = 'names' where a.mode <> 'names'),
n as (select dataset, mode, {_NOISE} from d group by all), t as (select 3 as n, 4.302652729911275 as t union all select 5, 2.7764451051977987)
select dataset, mode, n.n, round(mean, 6) as mean, round(sd, 6) as sd, round(greatest(range, 1.96 * sqrt(2.0) * sd), 6) as tie_threshold, round(mean - t * sd / sqrt(n.n), 6) as low, round(mean + t * sd / sqrt(n.n), 6) as high from n join t on n.n = t.n""",
        "run_scores",
    ),
)
def a11_repeat_ci(spark, sf_dir):
    return rounded(stats.repeat_ci(load(spark, sf_dir)["run_scores"], "names"))


@register(
    "a12_macro_by_repeat",
    oracle(f"with m as (select mode, repeat, avg(map5095) as v from run_scores group by all), n as (select mode, {_NOISE} from m group by all having count(*) >= 3) select mode, n, round(mean, 6) as mean, round(sd, 6) as sd, round(range, 6) as range, round(1.96 * sqrt(2.0) * sd, 6) as noise95, round(greatest(range, 1.96 * sqrt(2.0) * sd), 6) as tie_threshold from n", "run_scores"),
)
def a12_macro_by_repeat(spark, sf_dir):
    return rounded(stats.macro_by_repeat(load(spark, sf_dir)["run_scores"]))


_DOMAINS = "d as (select distinct dataset, concat('domain', cast(cast(substring(dataset, 3, 2) as int) % 4 as string)) as domain from run_scores)"


@register(
    "a6_domain_macro",
    oracle(f"with {_DOMAINS}, j as (select mode, domain, map5095 from mode_scores join d using (dataset)) select mode, coalesce(domain, 'All') as domain, round(avg(map5095), 6) as score, count(*) as n, true as reproduced from j group by grouping sets ((mode, domain), (mode))", "run_scores", "mode_scores"),
)
def a6_domain_macro(spark, sf_dir):
    t = load(spark, sf_dir)
    d = t["run_scores"].select("dataset").distinct().withColumn("domain", F.concat(F.lit("domain"), (F.substring("dataset", 3, 2).cast("int") % 4).cast("string")))
    return rounded(stats.domain_macro(t["mode_scores"], d))


_DELTAS = "dl as (select a.dataset, a.mode, a.map5095 - b.map5095 as delta from mode_scores a join mode_scores b on a.dataset = b.dataset and b.mode = 'names' where a.mode <> 'names')"


@register(
    "a7_label_group_gains",
    oracle(f"with {_DELTAS}, g as (select dataset, case when avg(flag) = 0 then 'none' when avg(flag) = 1 then 'all' else 'some' end as label_group from class_flags group by dataset) select label_group, mode, count(distinct dataset) as n_datasets, round(avg(delta), 6) as gain from dl join g using (dataset) group by all", "det_images", "det_categories", "run_scores", "class_flags", "mode_scores"),
)
def a7_label_group_gains(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(stats.label_group_gains(t["class_flags"], stats.paired_deltas(t["mode_scores"], "names", ["dataset"])))


@register(
    "a8_effects",
    oracle("with w as (select dataset, max(map5095) filter (where mode = 'names') as n, max(map5095) filter (where mode = 'one') as o, max(map5095) filter (where mode = 'ten') as t from mode_scores group by dataset) select dataset, round(o - n, 6) as gain_a, round(t - n, 6) as gain_both, round(t - o, 6) as step from w", "run_scores", "mode_scores"),
)
def a8_effects(spark, sf_dir):
    return rounded(stats.effects(load(spark, sf_dir)["mode_scores"], "names", "one", "ten"))


_ROWS = f"{_DELTAS}, r as (select f.dataset, f.category_id, f.flag, d.mode, d.delta + f.category_id as y from class_flags f join dl d using (dataset))"


def class_rows(t):
    d = stats.paired_deltas(t["mode_scores"], "names", ["dataset"])
    return t["class_flags"].join(d, "dataset").withColumn("y", F.col("delta") + F.col("category_id"))


@register(
    "a9_flag_and_slope",
    oracle(f"with {_ROWS} select mode, round(avg(y) filter (where flag = 1) - avg(y) filter (where flag = 0), 6) as effect, round(regr_slope(y, category_id), 6) as slope from r group by mode", "det_images", "det_categories", "run_scores", "class_flags", "mode_scores"),
)
def a9_flag_and_slope(spark, sf_dir):
    r = class_rows(load(spark, sf_dir))
    return rounded(stats.flag_effect(r, ["mode"], "flag", "y").join(stats.slope_effect(r, ["mode"], "category_id", "y"), "mode"))


@register(
    "a13_repeatability",
    oracle(
        """with reps as (select dataset, count(distinct mode) as n_rep from det_predictions group by dataset),
per as (select dataset, image_id, mode, list([category_id::double, x, y, w, h, score] order by category_id, x, y, w, h, score) as content, count(*) as n, list(category_id order by category_id) as classes from det_predictions group by all),
img as (select dataset, image_id, count(*) as seen, count(distinct content) as c, count(distinct n) as k, count(distinct classes) as q from per group by all)
select dataset, count(*) as n_images, round(avg(case when c = 1 then 1.0 else 0.0 end), 6) as same_content, round(avg(case when k = 1 then 1.0 else 0.0 end), 6) as same_count, round(avg(case when q = 1 then 1.0 else 0.0 end), 6) as same_classes
from img join reps using (dataset) where seen = n_rep group by dataset""",
        "det_images", "det_annotations", "det_predictions",
    ),
)
def a13_repeatability(spark, sf_dir):
    return rounded(stats.repeatability(load(spark, sf_dir)["det_predictions"]))


_DRAW = "((7 + it*7919 + pos*104729) * 48271 % 2147483647) % n"


@register(
    "a15_cluster_bootstrap",
    oracle(
        f"""with {_ROWS}, s as (select mode, dataset, sum(flag) as n1, sum(case when flag = 1 then y else 0.0 end) as s1, sum(1 - flag) as n0, sum(case when flag = 0 then y else 0.0 end) as s0, row_number() over (partition by mode order by dataset) - 1 as i from r group by mode, dataset),
k as (select mode, count(*)::bigint as n from s group by mode), dr as (select mode, it, {_DRAW} as i from (select mode, n, unnest(range(0, n)) as pos from k), (select unnest(range(0, 1000)) as it)),
e as (select mode, it, sum(s1) / nullif(sum(n1), 0) - sum(s0) / nullif(sum(n0), 0) as effect from dr join s using (mode, i) group by mode, it),
p as (select mode, sum(s1) / nullif(sum(n1), 0) - sum(s0) / nullif(sum(n0), 0) as estimate from s group by mode)
select mode, round(any_value(estimate), 6) as estimate, count(effect) as n_valid, round(quantile_cont(effect, 0.025), 6) as low, round(quantile_cont(effect, 0.975), 6) as high, count(effect) >= 950 as enough from e join p using (mode) group by mode""",
        "det_images", "det_categories", "run_scores", "class_flags", "mode_scores",
    ),
)
def a15_cluster_bootstrap(spark, sf_dir):
    r = class_rows(load(spark, sf_dir))
    one, ten = (stats.cluster_bootstrap(r.where(F.col("mode") == m), "flag", "y", 1000, 7).withColumn("mode", F.lit(m)) for m in ("one", "ten"))
    return rounded(one.unionByName(ten))


@register(
    "a15_cluster_effects",
    oracle(
        f"""with {_ROWS}, f as (select mode, 'flag' as kind, 'flag' as field, dataset, flag::double as x, y from r union all select mode, 'slope', 'category_id', dataset, category_id::double, y from r),
s as (select mode, kind, field, dataset, count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, row_number() over (partition by mode, kind, field order by dataset) - 1 as i, count(*) over (partition by mode, kind, field) as of from f group by mode, kind, field, dataset),
dr as (select mode, kind, field, it, ((7 + it*7919 + i*104729) * 48271 % 2147483647) % of as i from s cross join (select unnest(range(0, 1000)) as it)),
t as (select mode, kind, field, it, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from dr join s using (mode, kind, field, i) group by all union all select mode, kind, field, null, sum(n), sum(sx), sum(sy), sum(sxx), sum(sxy) from s group by all),
e as (select mode, kind, field, it, case kind when 'flag' then sxy / nullif(sx, 0) - (sy - sxy) / nullif(n - sx, 0) else (sxy - sx * sy / n) / nullif(sxx - sx * sx / n, 0) end as effect from t)
select mode, kind, field, round(any_value(effect) filter (where it is null), 6) as estimate, count(effect) filter (where it is not null) as n_valid, round(quantile_cont(effect, 0.025) filter (where it is not null), 6) as low, round(quantile_cont(effect, 0.975) filter (where it is not null), 6) as high from e group by mode, kind, field""",
        "det_images", "det_categories", "run_scores", "class_flags", "mode_scores",
    ),
)
def a15_cluster_effects(spark, sf_dir):
    return rounded(stats.cluster_effects(class_rows(load(spark, sf_dir)), ["mode"], ["flag"], ["category_id"], "y", 1000, 7))


#: An answer of every image in each mode: some alike in all modes.
_ANSWERS = "select dataset, image_id, mode, case when image_id % 4 = 0 then 'nothing here' when image_id % 4 = 1 and mode <> 'ten' then 'a box' else concat(mode, ' ', cast(image_id as string)) end as raw_response from det_images cross join (select 'names' as mode union all select 'one' union all select 'ten') m"


@register(
    "a13_repeat_agreement",
    oracle(
        f"""with ans as ({_ANSWERS}), t as (select dataset, image_id, count(distinct raw_response) as texts from ans group by all),
per as (select dataset, image_id, mode, list([category_id::double, x, y, w, h, score] order by category_id, x, y, w, h, score) as content, count(*) as n, list(category_id order by category_id) as classes from det_predictions group by all),
img as (select dataset, image_id, 3 - count(*) as bare, count(distinct content) as c, count(distinct n) as k, count(distinct classes) as q from per group by all),
d as (select t.dataset, t.image_id, texts, coalesce(bare, 3) as bare, coalesce(c, 0) as c, coalesce(k, 0) as k, coalesce(q, 0) as q from t left join img using (dataset, image_id)),
pairs as (select a.dataset, a.image_id, a.category_id, a.mode as ma, b.mode as mb, a.det_ord as l, b.det_ord as r, {iou_sql("a", "b")} as iou
  from det_predictions a join det_predictions b on a.dataset = b.dataset and a.image_id = b.image_id and a.category_id = b.category_id and a.mode < b.mode),
fold as (select dataset, image_id, category_id, ma, mb, list_reduce(list([l, r] order by iou desc, l desc, r desc),
   lambda a, p: case when list_contains(a[1], p[1]) or list_contains(a[2], p[2]) then a else [list_append(a[1], p[1]), list_append(a[2], p[2])] end, [[], []]::bigint[][]) as m from pairs where iou >= 0.5 group by all),
taken as (select dataset, image_id, category_id, ma, mb, unnest(m[1]) as l, unnest(m[2]) as r from fold),
met as (select t.dataset, t.image_id, t.ma, t.mb, count(*) as m, sum(iou) as iou from taken t join pairs using (dataset, image_id, category_id, ma, mb, l, r) group by all),
f as (select met.dataset, sum(2 * m / (a.n + b.n)::double) as f1, sum(m) as n_matches, sum(iou) as iou from met join per a on a.dataset = met.dataset and a.image_id = met.image_id and a.mode = ma join per b on b.dataset = met.dataset and b.image_id = met.image_id and b.mode = mb group by all)
select dataset, count(*) as n_images, 3 as n_repeats, round(avg(case when texts = 1 then 1.0 else 0.0 end), 6) as same_answer, round(avg(case when c + (bare > 0)::int = 1 then 1.0 else 0.0 end), 6) as same_content,
  round(avg(case when k + (bare > 0)::int = 1 then 1.0 else 0.0 end), 6) as same_count, round(avg(case when q + (bare > 0)::int = 1 then 1.0 else 0.0 end), 6) as same_classes, count(*) * 3 as n_pairs,
  round((coalesce(any_value(f1), 0.0) + sum(bare * (bare - 1) / 2)) / (count(*) * 3), 6) as mean_f1, coalesce(any_value(n_matches), 0)::bigint as n_matches, round(any_value(iou) / nullif(any_value(n_matches), 0), 6) as mean_iou
from d left join f using (dataset) group by dataset""",
        "det_images", "det_annotations", "det_predictions",
    ),
)
def a13_repeat_agreement(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(stats.repeat_agreement(t["det_predictions"], spark.sql(_ANSWERS)))


@register(
    "a14_image_bootstrap",
    oracle(
        "with " + _F1.lstrip() + f""",
w as (select dataset, image_id, sum(n_gt) filter (where mode = 'names') as ga, sum(n_pred) filter (where mode = 'names') as pa, sum(n_matched) filter (where mode = 'names') as ma,
        sum(n_gt) filter (where mode = 'ten') as gb, sum(n_pred) filter (where mode = 'ten') as pb, sum(n_matched) filter (where mode = 'ten') as mb,
        row_number() over (partition by dataset order by image_id) - 1 as pos, count(*) over (partition by dataset) as n from f1 group by dataset, image_id),
dr as (select dataset, it, {_DRAW} as pick from w cross join (select unnest(range(0, 20)) as it) q),
e as (select dr.dataset, it, 2 * sum(coalesce(mb, 0)) / sum(coalesce(gb, 0) + coalesce(pb, 0))::double - 2 * sum(coalesce(ma, 0)) / sum(coalesce(ga, 0) + coalesce(pa, 0))::double as delta from dr join w on dr.dataset = w.dataset and dr.pick = w.pos group by dr.dataset, it)
select dataset, round(avg(delta), 6) as mean, round(quantile_cont(delta, 0.025), 6) as low, round(quantile_cont(delta, 0.975), 6) as high, round(avg(case when delta > 0 then 1.0 else 0.0 end), 6) as p_better,
  quantile_cont(delta, 0.025) > 0 or quantile_cont(delta, 0.975) < 0 as excludes_zero, abs(avg(delta)) <= 0.2 as practically_equal from e group by dataset""",
        "det_images", "det_annotations", "det_predictions",
    ),
)
def a14_image_bootstrap(spark, sf_dir):
    t = load(spark, sf_dir)
    per = matching.image_f1(t["det_annotations"], t["det_predictions"])
    return rounded(stats.equivalence_decision(stats.bootstrap_interval(stats.image_bootstrap(per, "names", "ten", 20, 7)), "mean", 0.2))


def _ap_sql(iterations: int, seeds: tuple[int, ...], a: str, b: str) -> str:
    """Bootstrapped AP in DuckDB: a row for every detection, threshold and sample."""
    thr = ", ".join(repr(x) for x in coco.IOU_THRESHOLDS)
    its = f"(select unnest([{', '.join(map(str, seeds))}]) as seed) cross join (select unnest(range(0, {iterations})) as it)"
    return f"""p2 as (select * from det_predictions where mode in ('{a}', '{b}')), thrs as (select unnest([{thr}]::double[]) as thr),
pairs as (select p.dataset, p.mode, p.image_id, p.category_id, p.score, p.det_ord, a.ann_id, {iou_sql("p", "a")} as iou from p2 p join det_annotations a on a.dataset = p.dataset and a.image_id = p.image_id and a.category_id = p.category_id),
fold as (select dataset, mode, image_id, category_id, thr, list_reduce(list([det_ord, ann_id] order by score desc, det_ord, iou desc, ann_id desc),
             lambda a, p: case when list_contains(a[1], p[1]) or list_contains(a[2], p[2]) then a else [list_append(a[1], p[1]), list_append(a[2], p[2])] end, [[], []]::bigint[][]) as m
         from pairs join thrs on iou >= thr group by all),
hits as (select dataset, mode, image_id, category_id, thr, unnest(m[1]) as det_ord from fold),
im as (select dataset, image_id, row_number() over (partition by dataset order by image_id) - 1 as i, count(*) over (partition by dataset) as n from det_images),
dr as (select dataset, seed, it, ((seed + it*7919 + i*104729) * 48271 % 2147483647) % n as i from im cross join {its}),
k as (select dataset, seed, it, image_id, count(*) as k from dr join im using (dataset, i) group by all union all select dataset, null, null, image_id, 1 from im),
d as (select p.dataset, p.mode, p.category_id, t.thr, p.score, p.image_id, p.det_ord, case when h.det_ord is null then 0 else 1 end as tp from p2 p cross join thrs t
      left join hits h on h.dataset = p.dataset and h.mode = p.mode and h.image_id = p.image_id and h.category_id = p.category_id and h.thr = t.thr and h.det_ord = p.det_ord),
npig as (select dataset, category_id, seed, it, sum(k) as npig from det_annotations join k using (dataset, image_id) group by all),
run as (select d.dataset, mode, category_id, thr, seed, it, tp, k, sum(tp * k) over w as tps, sum(k) over w as n from d join k using (dataset, image_id)
        window w as (partition by d.dataset, mode, category_id, thr, seed, it order by score desc, d.image_id, det_ord rows unbounded preceding)),
env as (select dataset, mode, category_id, thr, seed, it, tps, k, max(tps / (n + 2.220446049250313e-16)) over (partition by dataset, mode, category_id, thr, seed, it order by tps desc) as best from run where tp = 1),
aps as (select e.dataset, mode, e.category_id, thr, e.seed, e.it, sum(best * len(list_filter(range(0, 101), lambda q: q * 0.01::double <= tps / npig::double and (tps = k or q * 0.01::double > (tps - k) / npig::double)))) / 101 as ap
        from env e join npig on npig.dataset = e.dataset and npig.category_id = e.category_id and npig.seed is not distinct from e.seed and npig.it is not distinct from e.it
     where tps = k or floor(tps * 100.0 / npig + 1e-6) <> floor((tps - k) * 100.0 / npig - 1e-6) group by all),  -- only these reach a recall
ap as (select x.dataset, m.mode, x.seed, x.it, 100 * avg(coalesce(ap, 0.0)) as ap, 100 * avg(coalesce(ap, 0.0)) filter (where t.thr = 0.5) as ap50
       from npig x cross join thrs t join (select distinct dataset, mode from p2) m on m.dataset = x.dataset
       left join aps on aps.dataset = x.dataset and aps.mode = m.mode and aps.category_id = x.category_id and aps.thr = t.thr and aps.seed is not distinct from x.seed and aps.it is not distinct from x.it group by all)"""


@register(
    "a14_ap_bootstrap",
    oracle(
        "with " + _ap_sql(20, (7, 20260811), "names", "ten") + """,
dl as (select x.dataset, x.seed, x.it, m.metric, case m.metric when 'ap' then y.ap - x.ap else y.ap50 - x.ap50 end as delta from ap x join ap y on y.dataset = x.dataset and x.mode = 'names' and y.mode = 'ten' and x.seed is not distinct from y.seed and x.it is not distinct from y.it
  cross join (select unnest(['ap', 'ap50']) as metric) m)
select b.dataset, b.seed, b.metric, round(any_value(o.delta), 6) as point, round(avg(b.delta), 6) as mean, round(quantile_cont(b.delta, 0.025), 6) as low, round(quantile_cont(b.delta, 0.975), 6) as high, round(avg(case when b.delta > 0 then 1.0 else 0.0 end), 6) as p_better,
  quantile_cont(b.delta, 0.025) > 0 or quantile_cont(b.delta, 0.975) < 0 as resolved, abs(any_value(o.delta)) <= 1.0 as equivalent
from dl b join dl o on o.dataset = b.dataset and o.metric = b.metric and o.it is null where b.it is not null group by all""",
        "det_images", "det_annotations", "det_predictions",
    ),
)
def a14_ap_bootstrap(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(stats.ap_bootstrap(t["det_annotations"], t["det_predictions"], t["det_images"], "names", "ten", 20, (7, 20260811)))


@register(
    "w7_efficient_best",
    oracle("with t as (select *, max(map5095) over (partition by dataset) as top from mode_scores), r as (select *, row_number() over (partition by dataset order by task_count, prompt_tokens, map5095 desc, mode) as rn from t where map5095 >= top - 5.0) select dataset, mode, round(map5095, 6) as map5095, cast(task_count as bigint) as task_count from r where rn = 1", "run_scores", "mode_scores"),
)
def w7_efficient_best(spark, sf_dir):
    return rounded(selection.efficient_best(load(spark, sf_dir)["mode_scores"], 5.0, ["dataset"]).select("dataset", "mode", "map5095", F.col("task_count").cast("long").alias("task_count")))


_THR = "th as (select dataset, max(greatest(range, 1.96 * sqrt(2.0) * sd)) * 3 as threshold from (select dataset, mode, max(map5095) - min(map5095) as range, stddev_samp(map5095) as sd from run_scores group by all) group by dataset)"


def thresholds_of(t):
    n = stats.repeat_noise(t["run_scores"], ["dataset", "mode"], "map5095")
    return n.groupBy("dataset").agg((F.max("tie_threshold") * 3).alias("threshold"))


@register(
    "w8_finalist_choice",
    oracle(
        f"""with {_THR}, m as (select mode, avg(map5095) as macro, sum(prompt_tokens) as prompt_tokens from mode_scores group by mode), b as (select mode as best from m order by macro desc, mode limit 1),
tie as (select s.mode, bool_and(abs(s.map5095 - x.map5095) <= threshold) as tied from mode_scores s join mode_scores x on s.dataset = x.dataset and x.mode = (select best from b) join th on s.dataset = th.dataset group by s.mode)
select mode, round(macro, 6) as macro, mode = (select best from b) as is_best, tied, tied and row_number() over (partition by tied order by prompt_tokens, macro desc, mode) = 1 as chosen from m join tie using (mode)""",
        "run_scores", "mode_scores",
    ),
)
def w8_finalist_choice(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(selection.finalist_choice(t["mode_scores"], thresholds_of(t), ("prompt_tokens",)))


@register(
    "w9_effort_gate",
    oracle(
        """with th as (select distinct dataset, 2.0 as threshold from run_scores), s as (select dataset, mode, map5095 + case mode when 'names' then 0 when 'one' then 60 else 61 end as v, case mode when 'names' then 0 when 'one' then 1 else 2 end as rank from mode_scores),
p as (select s.mode, s.rank, avg(s.v) as macro, bool_and(s.v - l.v > greatest(1.0, threshold)) as passed from s join s l on s.dataset = l.dataset and l.rank = 0 join th on s.dataset = th.dataset group by all),
b as (select mode from p where passed order by macro desc, rank limit 1),
tie as (select s.mode, bool_and(abs(s.v - x.v) <= threshold) as tied from s join s x on s.dataset = x.dataset and x.mode = (select mode from b) join th on s.dataset = th.dataset group by s.mode)
select mode, round(macro, 6) as macro, passed, row_number() over (order by (coalesce(tied, false) and passed) desc, rank) = 1 as chosen from p left join tie using (mode)""",
        "run_scores", "mode_scores",
    ),
)
def w9_effort_gate(spark, sf_dir):
    t = load(spark, sf_dir)
    s = t["mode_scores"].select("dataset", "mode", (F.col("map5095") + F.when(F.col("mode") == "names", 0).when(F.col("mode") == "one", 60).otherwise(61)).alias("map5095"))
    th = s.select("dataset").distinct().withColumn("threshold", F.lit(2.0))
    return rounded(selection.effort_gate(s, th, ["names", "one", "ten"]))


@register(
    "w10_ranking",
    oracle("with m as (select mode, avg(map5095) as map5095 from mode_scores group by mode) select cast(row_number() over (order by map5095 desc, mode) as int) as place, mode, round(map5095, 6) as map5095, max(map5095) over () - map5095 <= 0.5 as close from m", "run_scores", "mode_scores"),
)
def w10_ranking(spark, sf_dir):
    return rounded(selection.ranking(runs.macro_summary(load(spark, sf_dir)["mode_scores"]).select("mode", "map5095"), 0.5))


@register(
    "w11_binary_route",
    oracle("select a.dataset, case when b.map5095 - a.map5095 >= 2.0 and b.map50 - a.map50 >= 0 then 'ten' else 'names' end as selected_mode from mode_scores a join mode_scores b on a.dataset = b.dataset where a.mode = 'names' and b.mode = 'ten'", "run_scores", "mode_scores"),
)
def w11_binary_route(spark, sf_dir):
    s = load(spark, sf_dir)["mode_scores"].select("dataset", "mode", F.col("map5095").alias("recall"), F.col("map50").alias("recall50"))
    return selection.binary_route(s, "names", "ten", 2.0)


@register(
    "w12_count_route",
    oracle(
        """with s as (select dataset, repeat, max(map5095) as r, max(map50) as r50 from run_scores group by all),
f as (select dataset, list_reduce(list([repeat::double, r, r50] order by repeat), lambda a, x: case when x[2] - a[2] >= 1.0 and x[3] - a[3] >= 0 then [x[1], x[2], x[3]] else a end) as g, count(*) as n from s group by dataset)
select dataset, cast(g[1] as int) as selected from f where n = 5""",
        "run_scores",
    ),
)
def w12_count_route(spark, sf_dir):
    s = load(spark, sf_dir)["run_scores"].groupBy("dataset", F.col("repeat").alias("count")).agg(F.max("map5095").alias("recall"), F.max("map50").alias("recall50"))
    return selection.count_route(s, [1, 2, 3, 4, 5], 1.0).select("dataset", "selected")


@register(
    "w13_majority_route",
    oracle(
        """with v as (select concat('ds', lpad(cast(conv_id % 40 as string), 2, '0')) as dataset, case when length(text) % 2 = 0 then 'one' else 'names' end as route from conversations),
c as (select dataset, route, count(*) as n from v group by all), k as (select dataset, count(*) = 1 as stable from c group by dataset)
select dataset, route, stable from (select *, row_number() over (partition by dataset order by n desc, case when route = 'one' then 0 else 1 end, route) as rn from c) join k using (dataset) where rn = 1""",
    ),
)
def w13_majority_route(spark, sf_dir):
    c = load(spark, sf_dir)["conversations"]
    v = c.select(F.concat(F.lit("ds"), F.lpad((F.col("conv_id") % 40).cast("string"), 2, "0")).alias("dataset"), F.when(F.length("text") % 2 == 0, "one").otherwise("names").alias("route"))
    return selection.majority_route(v, "one")


_ROUTES = "rt as (select a.dataset, case when b.map5095 - a.map5095 >= 2.0 and b.map50 - a.map50 >= 0 then 'ten' else 'names' end as selected_mode, cast(substring(a.dataset, 3, 2) as int) % 2 = 0 as held_out from mode_scores a join mode_scores b on a.dataset = b.dataset where a.mode = 'names' and b.mode = 'ten')"


def routes_of(t):
    s = t["mode_scores"].select("dataset", "mode", F.col("map5095").alias("recall"), F.col("map50").alias("recall50"))
    return selection.binary_route(s, "names", "ten", 2.0).withColumn("held_out", F.substring("dataset", 3, 2).cast("int") % 2 == 0)


@register(
    "w14_apply_routes",
    oracle(f"with {_ROUTES}, j as (select rt.held_out, s.map5095 as s, b.map5095 as b from rt join mode_scores s on rt.dataset = s.dataset and rt.selected_mode = s.mode join mode_scores b on rt.dataset = b.dataset and b.mode = 'names'), k as (select 'all' as part, s, b from j union all select 'held_out', s, b from j where held_out) select part, count(*) as n_datasets, round(avg(s), 6) as macro, round(avg(b), 6) as baseline_macro, round(avg(s - b), 6) as gain from k group by part", "run_scores", "mode_scores"),
)
def w14_apply_routes(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(selection.apply_routes(routes_of(t), t["mode_scores"], "names"))


@register(
    "w15_route_accuracy",
    oracle(f"with {_ROUTES} select count(*) as n_datasets, round(avg(case when (case when b.map5095 > a.map5095 then 'ten' else 'names' end) = selected_mode then 1.0 else 0.0 end), 6) as accuracy from rt join mode_scores a on rt.dataset = a.dataset and a.mode = 'names' join mode_scores b on rt.dataset = b.dataset and b.mode = 'ten'", "run_scores", "mode_scores"),
)
def w15_route_accuracy(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(selection.route_accuracy(routes_of(t), t["mode_scores"], "names", "ten"))


@register(
    "t3_request_rate",
    oracle("select event_id, count(*) over w as calls, count(*) over w > 3 as over_limit from task_log window w as (partition by mode order by completed_at range between interval 60 seconds preceding and current row)", "task_log"),
)
def t3_request_rate(spark, sf_dir):
    return runs.attempt_rate(load(spark, sf_dir)["task_log"], "mode", 60, 3).select("event_id", "calls", "over_limit")


@register(
    "a12_count_contrasts",
    oracle(
        f"""with r as (select dataset, mode, repeat, map5095 as v from run_scores union all select 'macro', mode, repeat, avg(map5095) from run_scores group by mode, repeat),
p as (select 'ten' as "left", 'one' as "right" union all select 'ten', 'names' union all select 'one', 'names'),
d as (select a.dataset, p."left", p."right", a.v - b.v as v from p join r a on a.mode = p."left" join r b on b.mode = p."right" and a.dataset = b.dataset and a.repeat = b.repeat),
n as (select dataset, "left", "right", {_NOISE} from d group by all having count(*) >= 3), t as (select 3 as n, 4.302652729911275 as t union all select 5, 2.7764451051977987)
select dataset, "left", "right", n.n, round(mean, 6) as mean, round(sd, 6) as sd, round(greatest(range, 1.96 * sqrt(2.0) * sd), 6) as tie_threshold, round(mean - t * sd / sqrt(n.n), 6) as low, round(mean + t * sd / sqrt(n.n), 6) as high from n join t on n.n = t.n""",
        "run_scores",
    ),
)
def a12_count_contrasts(spark, sf_dir):
    return rounded(stats.count_contrasts(load(spark, sf_dir)["run_scores"], [("ten", "one"), ("ten", "names"), ("one", "names")]))


@register(
    "a4_failure_counts",
    oracle(
        """with r as (select mode as dataset, status, case event_id % 5 when 0 then 'timeout' when 1 then 'max_tokens' when 2 then 'invalid_response' when 3 then 'provider_request_failure' end as f from task_log)
select dataset, count(*) filter (where status in ('success', 'model_failure')) as n_completed, count(*) filter (where status = 'success') as n_success, count(*) filter (where status = 'error') as n_error, count(*) filter (where status = 'model_failure') as n_model_failure,
count(*) filter (where status = 'model_failure' and f = 'timeout') as n_timeout, count(*) filter (where status = 'model_failure' and f = 'max_tokens') as n_max_tokens, count(*) filter (where status = 'model_failure' and f = 'invalid_response') as n_invalid_response,
count(*) filter (where status = 'model_failure' and (f is null or f = 'provider_request_failure')) as n_other_failure from r group by dataset""", "task_log"),
)
def a4_failure_counts(spark, sf_dir):
    k = F.col("event_id") % 5
    kind = F.when(k == 0, "timeout").when(k == 1, "max_tokens").when(k == 2, "invalid_response").when(k == 3, "provider_request_failure")
    return runs.failure_counts(load(spark, sf_dir)["task_log"].select(F.col("mode").alias("dataset"), "status", kind.alias("failure_type")))


@register(
    "a20_candidate_rows",
    oracle(
        """with n as (select dataset, count(*) as n_images from det_images group by dataset), s as (select * from mode_scores join n using (dataset) where dataset in ('ds00', 'ds01'))
select mode, min(case when mode = 'names' then 'class_names' else 'boxes' end) as semantics, cast(min(length(mode)) as int) as box_count, round(max(case when dataset = 'ds00' then map5095 end), 6) as ds00_map5095, round(max(case when dataset = 'ds00' then map50 end), 6) as ds00_map50,
round(max(case when dataset = 'ds01' then map5095 end), 6) as ds01_map5095, round(max(case when dataset = 'ds01' then map50 end), 6) as ds01_map50, round(avg(map5095), 6) as macro_map5095, round(avg(map50), 6) as macro_map50,
round(avg(prompt_tokens / n_images::double), 6) as prompt_tokens_per_image, round(avg(completion_tokens / n_images::double), 6) as completion_tokens_per_image, round(avg(cached_tokens / n_images::double), 6) as reasoning_tokens_per_image,
round(avg(prompt_tokens / n_images::double) + avg(completion_tokens / n_images::double), 6) as total_tokens_per_image, round(avg(task_count / n_images::double), 6) as seconds_per_image, cast(sum(task_count % 7) as bigint) as model_failures, cast(sum(task_count % 3) as bigint) as errors from s group by mode""",
        "det_images", "run_scores", "mode_scores",
    ),
)
def a20_candidate_rows(spark, sf_dir):
    t = load(spark, sf_dir)
    s = t["mode_scores"].withColumnRenamed("cached_tokens", "reasoning_tokens").withColumns(
        {"semantics": F.when(F.col("mode") == "names", "class_names").otherwise("boxes"), "box_count": F.length("mode"), "total_seconds": F.col("task_count"), "model_failures": F.col("task_count") % 7, "errors": F.col("task_count") % 3}
    )
    n = t["det_images"].groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"))
    return rounded(runs.candidate_rows(s, n, ["ds00", "ds01"], ["semantics", "box_count"]))
