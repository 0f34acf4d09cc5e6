"""Registered queries over the derived detection tables: scoring and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxyard.functions import geometry
from boxyard.functions.fixtures import load, oracle
from boxyard.operators import coco, matching
from boxyard.plans.catalog import register

IOU = "case when {a}.w*{a}.h + {b}.w*{b}.h - {i} > 0 then {i} / ({a}.w*{a}.h + {b}.w*{b}.h - {i}) else 0.0 end"


def iou_sql(a: str, b: str) -> str:
    i = f"(greatest(0.0, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))"
    return IOU.format(a=a, b=b, i=i)


def rounded(df, digits: int = 6):
    """Doubles to a fixed number of digits, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


_GREEDY = """
pairs as (select p.dataset, p.mode, p.image_id, p.category_id, a.ann_id as l, p.det_ord as r, {iou} as iou
          from det_annotations a join det_predictions p on a.dataset = p.dataset and a.image_id = p.image_id and a.category_id = p.category_id),
fold as (select dataset, mode, image_id, category_id,
           list_reduce(list([l, r] order by iou desc, l desc, r desc),
             lambda a, p: case when list_contains(a[1], p[1]) or list_contains(a[2], p[2]) then a else [list_append(a[1], p[1]), list_append(a[2], p[2])] end, [[], []]::bigint[][]) as m
         from pairs where iou >= 0.5 group by all),
taken as (select dataset, mode, image_id, category_id, unnest(m[1]) as l, unnest(m[2]) as r from fold)""".format(iou=iou_sql("a", "p"))

_F1 = (
    _GREEDY
    + """,
modes as (select distinct dataset, mode from det_predictions),
ng as (select a.dataset, m.mode, a.image_id, a.category_id, count(*) as n_gt from det_annotations a join modes m on a.dataset = m.dataset group by all),
np as (select dataset, mode, image_id, category_id, count(*) as n_pred from det_predictions group by all),
nm as (select dataset, mode, image_id, category_id, count(*) as n_matched from taken group by all),
f1 as (select dataset, mode, image_id, category_id, coalesce(n_gt, 0) as n_gt, coalesce(n_pred, 0) as n_pred, coalesce(n_matched, 0) as n_matched,
         2 * coalesce(n_matched, 0) / (coalesce(n_gt, 0) + coalesce(n_pred, 0))::double as f1
       from ng full join np using (dataset, mode, image_id, category_id) left join nm using (dataset, mode, image_id, category_id))"""
)


@register(
    "slice_macro_f1",
    oracle(
        "with " + _F1.lstrip() + """,
per as (select dataset, mode, sum(n_gt) as g, sum(n_pred) as p, sum(n_matched) as m from f1 group by all)
select mode, count(*) as n_datasets, round(avg(m / p), 6) as precision, round(avg(m / g), 6) as recall, round(avg(2 * m / (g + p)), 6) as f1 from per group by mode""",
        "det_annotations", "det_predictions",
    ),
)
def slice_macro_f1(spark, sf_dir):
    t = load(spark, sf_dir)
    per = matching.precision_recall(t["det_annotations"], t["det_predictions"])
    return rounded(per.groupBy("mode").agg(F.count(F.lit(1)).alias("n_datasets"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]))


@register(
    "j3_match_candidates",
    oracle("with " + _GREEDY.lstrip() + " select dataset, mode, image_id, category_id, l, r, round(iou, 6) as iou from pairs where iou >= 0.5", "det_annotations", "det_predictions"),
)
def j3_match_candidates(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(matching.object_candidates(t["det_annotations"], t["det_predictions"], 0.5))


@register("j4_greedy_match", oracle("with " + _GREEDY.lstrip() + " select * from taken", "det_annotations", "det_predictions"))
def j4_greedy_match(spark, sf_dir):
    t = load(spark, sf_dir)
    return matching.greedy_match(matching.object_candidates(t["det_annotations"], t["det_predictions"], 0.5), coco.GROUP).drop("iou")


@register("c6_image_f1", oracle("with " + _F1.lstrip() + " select dataset, mode, image_id, category_id, n_gt, n_pred, n_matched, round(f1, 6) as f1 from f1", "det_annotations", "det_predictions"))
def c6_image_f1(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(matching.image_f1(t["det_annotations"], t["det_predictions"]))


@register(
    "c7_most_changed_image",
    oracle(
        "with " + _F1.lstrip() + """
select dataset, category_id, image_id, round(f1_before, 6) as f1_before, round(f1_after, 6) as f1_after, round(delta, 6) as delta from (
  select a.dataset, a.category_id, a.image_id, a.f1 as f1_before, b.f1 as f1_after, b.f1 - a.f1 as delta,
         row_number() over (partition by a.dataset, a.category_id order by b.f1 - a.f1 desc, a.n_gt + a.n_pred + b.n_pred, a.image_id desc) as rn
  from f1 a join f1 b using (dataset, category_id, image_id) where a.mode = 'names' and b.mode = 'ten' and a.n_gt > 0) where rn = 1""",
        "det_annotations", "det_predictions",
    ),
)
def c7_most_changed_image(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(matching.most_changed_image(matching.image_f1(t["det_annotations"], t["det_predictions"]), "names", "ten"))


@register(
    "c4_known_object_recall",
    oracle(
        """with thr as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::double[]) as t),
pairs as (select p.dataset, p.mode, p.image_id, p.category_id, a.ann_id as l, p.det_ord as r, """ + iou_sql("a", "p") + """ as iou
          from det_annotations a join det_predictions p on a.dataset = p.dataset and a.image_id = p.image_id and a.category_id = p.category_id),
fold as (select dataset, mode, image_id, category_id, t,
           list_reduce(list([l, r] order by iou desc, l desc, r desc),
             lambda a, p: case when list_contains(a[1], p[1]) or list_contains(a[2], p[2]) then a else [list_append(a[1], p[1]), list_append(a[2], p[2])] end, [[], []]::bigint[][]) as m
         from pairs join thr on iou >= t group by all),
found as (select dataset, mode, category_id, t, sum(len(m[1])) as n from fold group by all),
n as (select a.dataset, m.mode, a.category_id, count(*) as n_objects from det_annotations a join (select distinct dataset, mode from det_predictions) m on a.dataset = m.dataset group by all),
per as (select n.dataset, n.mode, n.category_id, n_objects, coalesce(sum(case when t = 0.5 then f.n end), 0) as f50, coalesce(sum(f.n), 0) / 10.0 as f
        from n left join found f on n.dataset = f.dataset and n.mode = f.mode and n.category_id = f.category_id group by all)
select dataset, mode, round(sum(f50) / sum(n_objects), 6) as micro_recall50, round(sum(f) / sum(n_objects), 6) as micro_recall,
       round(avg(f50 / n_objects), 6) as macro_recall50, round(avg(f / n_objects), 6) as macro_recall from per group by all""",
        "det_annotations", "det_predictions",
    ),
)
def c4_known_object_recall(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(matching.recall_summary(matching.known_object_recall(t["det_annotations"], t["det_predictions"])))


@register(
    "c5_detection_agreement",
    oracle(
        """with g as (select 'names' as mode_a, 'one' as mode_b union all select 'names', 'ten' union all select 'one', 'ten'),
pairs as (select a.dataset, a.image_id, a.category_id, g.mode_a, g.mode_b, a.det_ord as l, b.det_ord as r, """ + iou_sql("a", "b") + """ as iou
          from det_predictions a join g on a.mode = g.mode_a join det_predictions b on b.mode = g.mode_b and a.dataset = b.dataset and a.image_id = b.image_id and a.category_id = b.category_id),
fold as (select dataset, image_id, category_id, mode_a, mode_b,
           list_reduce(list([l, r] order by iou desc, l desc, r desc),
             lambda a, p: case when list_contains(a[1], p[1]) or list_contains(a[2], p[2]) then a else [list_append(a[1], p[1]), list_append(a[2], p[2])] end, [[], []]::bigint[][]) as m
         from pairs where iou >= 0.5 group by all),
taken as (select dataset, image_id, category_id, mode_a, mode_b, unnest(m[1]) as l, unnest(m[2]) as r from fold),
nm as (select t.dataset, t.image_id, t.mode_a, t.mode_b, count(*) as n_matched, sum(iou) as sum_iou from taken t join pairs using (dataset, image_id, category_id, mode_a, mode_b, l, r) group by all),
c as (select dataset, image_id, mode, count(*) as n from det_predictions group by all)
select i.dataset, i.image_id, g.mode_a, g.mode_b, coalesce(ca.n, 0) as n_left, coalesce(cb.n, 0) as n_right, coalesce(n_matched, 0) as n_matched,
       round(case when coalesce(ca.n, 0) + coalesce(cb.n, 0) = 0 then 1.0::double else 2 * coalesce(n_matched, 0) / (coalesce(ca.n, 0) + coalesce(cb.n, 0))::double end, 6) as f1, round(coalesce(sum_iou, 0.0), 6) as sum_iou
from det_images i cross join g
left join c ca on ca.dataset = i.dataset and ca.image_id = i.image_id and ca.mode = g.mode_a left join c cb on cb.dataset = i.dataset and cb.image_id = i.image_id and cb.mode = g.mode_b
left join nm on nm.dataset = i.dataset and nm.image_id = i.image_id and nm.mode_a = g.mode_a and nm.mode_b = g.mode_b""",
        "det_images", "det_annotations", "det_predictions",
    ),
)
def c5_detection_agreement(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(matching.detection_agreement(t["det_predictions"], t["det_images"], [("names", "one"), ("names", "ten"), ("one", "ten")]))


def _coco_sql(areas: dict, max_dets: int) -> str:
    thr = ", ".join(repr(x) for x in coco.IOU_THRESHOLDS)
    ar = " union all ".join(f"select '{k}' as area, {lo}::double as lo, {hi}::double as hi" for k, (lo, hi) in areas.items())
    return f"""cells as (select t.thr, a.* from (select unnest([{thr}]::double[]) as thr) t cross join ({ar}) a),
pr as (select * from (select *, row_number() over (partition by dataset, mode, image_id, category_id order by score desc, det_ord) as rk from det_predictions) where rk <= {max_dets}),
pairs as (select p.dataset, p.mode, p.image_id, p.category_id, p.score, p.det_ord, a.ann_id, a.w*a.h as garea, {iou_sql("p", "a")} as iou
          from pr p join det_annotations a on a.dataset = p.dataset and a.image_id = p.image_id and a.category_id = p.category_id),
k as (select *, case when garea < lo or garea > hi then 1 else 0 end as ig from pairs join cells on iou >= least(thr, 1 - 1e-10)),
fold as (select dataset, mode, image_id, category_id, thr, area,
           list_reduce(list([det_ord, ann_id, ig] order by score desc, det_ord, ig, iou desc, ann_id desc),
             lambda a, p: case when list_contains(a[1], p[1]) or list_contains(a[2], p[2]) then a else [list_append(a[1], p[1]), list_append(a[2], p[2]), list_append(a[3], p[3])] end, [[], [], []]::bigint[][]) as m
         from k group by all),
hits as (select dataset, mode, image_id, category_id, thr, area, unnest(m[1]) as det_ord, unnest(m[2]) as ann_id, unnest(m[3]) as ig from fold),
d as (select p.dataset, p.mode, p.category_id, c.thr, c.area, p.score, p.image_id, p.det_ord, case when h.ann_id is null then 0 else 1 end as tp
      from pr p cross join cells c left join hits h on h.dataset = p.dataset and h.mode = p.mode and h.image_id = p.image_id and h.category_id = p.category_id and h.thr = c.thr and h.area = c.area and h.det_ord = p.det_ord
      where not coalesce(h.ig = 1, p.w*p.h < c.lo or p.w*p.h > c.hi)),
npig as (select a.dataset, m.mode, a.category_id, c.thr, c.area, count(*) as npig from det_annotations a join (select distinct dataset, mode from det_predictions) m on a.dataset = m.dataset
         join cells c on a.w*a.h >= c.lo and a.w*a.h <= c.hi group by all),
run as (select *, sum(tp) over w as tps, count(*) over w as n from d window w as (partition by dataset, mode, category_id, thr, area order by score desc, image_id, det_ord rows unbounded preceding)),
curve as (select dataset, mode, category_id, thr, area, tps / npig::double as rc, tps / (n + 2.220446049250313e-16) as prec from run join npig using (dataset, mode, category_id, thr, area) where tp = 1),
pts as (select dataset, mode, category_id, thr, area, q.k, max(prec) as prec from curve join (select unnest(range(0, 101)) as k) q on rc >= q.k * 0.01::double group by all),
aps as (select dataset, mode, category_id, thr, area, sum(prec) / 101 as ap from pts group by all),
ars as (select dataset, mode, category_id, thr, area, max(rc) as ar from curve group by all),
cell as (select npig.*, coalesce(ap, 0.0) as ap, coalesce(ar, 0.0) as ar from npig left join aps using (dataset, mode, category_id, thr, area) left join ars using (dataset, mode, category_id, thr, area))"""


_ALL = {"all": geometry.AREAS["all"]}


@register("c1_coco_match", oracle("with " + _coco_sql(_ALL, 500) + " select dataset, mode, image_id, category_id, round(thr, 6) as thr, area, det_ord, ann_id, cast(ig as int) as ig from hits", "det_annotations", "det_predictions"))
def c1_coco_match(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(coco.coco_match(t["det_annotations"], t["det_predictions"]).drop("cell"))


@register(
    "c2_coco_score",
    oracle(
        "with " + _coco_sql(geometry.AREAS, 500) + "\n" + """select dataset, mode, round(avg(ap) filter (where area = 'all'), 6) as ap, round(avg(ap) filter (where area = 'all' and thr = 0.5), 6) as ap50,
  round(avg(ap) filter (where area = 'all' and abs(thr - 0.75) < 1e-9), 6) as ap75,
  round(coalesce(avg(ap) filter (where area = 'small'), -1.0), 6) as ap_small, round(coalesce(avg(ap) filter (where area = 'medium'), -1.0), 6) as ap_medium, round(coalesce(avg(ap) filter (where area = 'large'), -1.0), 6) as ap_large,
  round(coalesce(avg(ar) filter (where area = 'small'), -1.0), 6) as ar_small, round(coalesce(avg(ar) filter (where area = 'medium'), -1.0), 6) as ar_medium, round(coalesce(avg(ar) filter (where area = 'large'), -1.0), 6) as ar_large,
  round(avg(ar) filter (where area = 'all'), 6) as ar_500 from cell group by all""",
        "det_annotations", "det_predictions",
    ),
)
def c2_coco_score(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(coco.coco_score(t["det_annotations"], t["det_predictions"], max_dets=(500,)))


@register("c2_coco_recall_few", oracle("with " + _coco_sql(_ALL, 1) + " select dataset, mode, round(avg(ar), 6) as ar_1 from cell group by all", "det_annotations", "det_predictions"))
def c2_coco_recall_few(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(coco.coco_recalls(t["det_annotations"], t["det_predictions"], (1,)))


@register(
    "c2_coco_summary",
    oracle(
        "with " + _coco_sql(_ALL, 500) + """, first as (select h.dataset, h.mode, h.category_id, h.thr, count(*) filter (where rk <= 1) as r1, count(*) filter (where rk <= 10) as r10 from hits h join pr using (dataset, mode, image_id, category_id, det_ord) where h.ig = 0 group by all)
select dataset, mode, round(avg(cell.ap), 6) as ap, round(avg(coalesce(r1, 0) / cell.npig::double), 6) as ar_1, round(avg(coalesce(r10, 0) / cell.npig::double), 6) as ar_10, round(avg(cell.ar), 6) as ar_500
from cell left join first using (dataset, mode, category_id, thr) group by all""",
        "det_annotations", "det_predictions",
    ),
)
def c2_coco_summary(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(coco.coco_score(t["det_annotations"], t["det_predictions"], ("all",), (1, 10, 500)).select("dataset", "mode", "ap", "ar_1", "ar_10", "ar_500"))


@register(
    "c3_coco_by_category",
    oracle(
        "with " + _coco_sql(_ALL, 500) + " select dataset, mode, category_id, round(100 * avg(ap), 6) as ap, round(100 * avg(ap) filter (where thr = 0.5), 6) as ap50, round(100 * avg(ap) filter (where abs(thr - 0.75) < 1e-9), 6) as ap75, max(npig) as n_objects from cell group by all",
        "det_annotations", "det_predictions",
    ),
)
def c3_coco_by_category(spark, sf_dir):
    t = load(spark, sf_dir)
    return rounded(coco.coco_score_by_category(t["det_annotations"], t["det_predictions"]))
