"""Detection tables derived by SQL from the star-schema tables; one text serves Spark and DuckDB, but for det_predictions, whose rows Spark makes from one reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW = ("orders", "lineitem", "events", "embeddings", "documents", "conversations")

TABLES = {
    "det_images": """
select concat('ds', lpad(cast(o_custkey % 20 as string), 2, '0')) as dataset, o_orderkey as image_id,
       concat('img_', cast(o_orderkey as string), '.jpg') as file_name,
       cast(640 + 32*(o_orderkey % 8) as int) as width, cast(480 + 16*(o_orderkey % 10) as int) as height
from orders""",
    "det_categories": """
select d.dataset, c.category_id, c.name, c.category_id as cat_ord
from (select distinct dataset from det_images) d
cross join (select 0 as category_id, 'cat' as name union all select 1, 'caterpillar' union all select 2, 'Sea  Lion') c""",
    "det_annotations": """
select i.dataset, l.image_id, l.image_id*100 + l.rn as ann_id, l.category_id, l.x, l.y, l.w, l.h
from (select l_orderkey as image_id,
             row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as rn,
             cast(l_partkey % 3 as int) as category_id,
             cast((l_suppkey*37 + l_linenumber*61) % 400 as double) as x,
             cast((l_partkey*29 + l_linenumber*43) % 300 as double) as y,
             20 + 2*l_quantity as w, cast(16 + l_partkey % 97 as double) as h
      from lineitem) l
join det_images i on i.image_id = l.image_id""",
    "det_predictions": """
select dataset, mode, image_id, category_id, x, y, w, h, score,
       row_number() over (partition by mode, image_id order by ann_id, kind) as det_ord
from (
  select a.dataset, m.mode, a.image_id, a.category_id, a.ann_id, 0 as kind,
         a.x + ((a.ann_id*13 + m.k*5) % 9) as x, a.y + ((a.ann_id*7 + m.k*3) % 7) as y,
         a.w + ((a.ann_id*5 + m.k) % 11) - 5 as w, a.h + ((a.ann_id*3 + m.k) % 9) - 4 as h,
         cast(((a.ann_id*17 + m.k*29) % 100) as double)/100 as score
  from det_annotations a cross join (select 'names' as mode, 0 as k union all select 'one', 1 union all select 'ten', 2) m
  where (a.ann_id*7 + m.k*3) % 10 < 6 + m.k
  union all
  select a.dataset, m.mode, a.image_id, (a.category_id + 1) % 3, a.ann_id, 1, a.x + 90, a.y + 10, a.w, a.h,
         cast(((a.ann_id*31 + m.k*7) % 100) as double)/100
  from det_annotations a cross join (select 'names' as mode, 0 as k union all select 'one', 1 union all select 'ten', 2) m
  where (a.ann_id*11 + m.k) % 6 = 0) t""",
    "run_scores": """
select concat('ds', lpad(cast(l_suppkey % 20 as string), 2, '0')) as dataset,
       case l_returnflag when 'A' then 'names' when 'N' then 'one' else 'ten' end as mode,
       cast(l_linenumber % 5 + 1 as int) as repeat,
       cast(cast(sum(l_quantity) as bigint) % 4000 as double)/100 as map5095,
       cast(cast(sum(l_quantity) as bigint) % 4000 + sum(l_partkey) % 3000 as double)/100 as map50,
       cast(sum(l_partkey) as bigint) as prompt_tokens, cast(floor(sum(l_partkey)/4) as bigint) as cached_tokens,
       cast(sum(l_suppkey) as bigint) as completion_tokens, cast(count(*) as bigint) as task_count
from lineitem group by 1, 2, 3""",
    "task_log": """
select event_id, concat('task_', cast(user_id as string), '_', cast(event_id % 40 as string)) as task_key,
       case event_id % 3 when 0 then 'names' when 1 then 'one' else 'ten' end as mode, ts as completed_at,
       case event_type when 'error' then 'error' when 'signup' then 'model_failure' else 'success' end as status,
       value as inference_seconds, cast(regexp_extract(props, '([0-9]+)', 1) as bigint)*10 as prompt_tokens,
       cast(regexp_extract(props, '([0-9]+)', 1) as bigint)*3 as cached_tokens, event_id % 500 as completion_tokens
from events""",
    "class_flags": """
select dataset, category_id,
       cast(case when cast(substring(dataset, 3, 2) as int) % 3 = 0 then 0
                 when cast(substring(dataset, 3, 2) as int) % 3 = 1 then 1
                 else category_id % 2 end as int) as flag
from det_categories""",
    # one row for each dataset and mode, from the repeats
    "mode_scores": """
select dataset, mode, avg(map5095) as map5095, avg(map50) as map50, sum(prompt_tokens) as prompt_tokens, sum(cached_tokens) as cached_tokens,
       sum(completion_tokens) as completion_tokens, sum(task_count) as task_count
from run_scores group by 1, 2""",
}

_NEEDS = {
    "det_categories": ["det_images"], "det_annotations": ["det_images"], "det_predictions": ["det_images", "det_annotations"],
    "class_flags": ["det_images", "det_categories"], "mode_scores": ["run_scores"],
}


def _annotations(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    """det_annotations, from rows that are dealt once, by order, before anything is derived from them.

    Their place among the boxes, their image and all that is asked of an image afterwards needs no other dealing.
    """
    lineitem.repartition("l_orderkey").createOrReplaceTempView("lineitem")
    out = spark.sql(TABLES["det_annotations"])
    lineitem.createOrReplaceTempView("lineitem")
    return out


def _predictions(annotations: DataFrame) -> DataFrame:
    """det_predictions, all rows of an object from one reading of it: a union of readings would be dealt again."""

    def of(mode: str, k: int) -> list[Column]:
        at = lambda text, name: F.expr(text.format(k=k)).alias(name)
        near = [at("category_id", "category_id"), at("x + ((ann_id*13 + {k}*5) % 9)", "x"), at("y + ((ann_id*7 + {k}*3) % 7)", "y"), at("w + ((ann_id*5 + {k}) % 11) - 5", "w"), at("h + ((ann_id*3 + {k}) % 9) - 4", "h"), at("cast(((ann_id*17 + {k}*29) % 100) as double)/100", "score")]
        far = [at("(category_id + 1) % 3", "category_id"), at("x + 90", "x"), at("y + 10", "y"), at("w", "w"), at("h", "h"), at("cast(((ann_id*31 + {k}*7) % 100) as double)/100", "score")]
        row = lambda kind, values: F.struct(F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), *values)
        return [F.when(F.expr(f"(ann_id*7 + {k}*3) % 10 < 6 + {k}"), row(0, near)), F.when(F.expr(f"(ann_id*11 + {k}) % 6 = 0"), row(1, far))]

    rows = F.array_compact(F.array(*[r for k, mode in enumerate(("names", "one", "ten")) for r in of(mode, k)]))
    d = annotations.select("dataset", "image_id", "ann_id", F.inline(rows))
    place = F.row_number().over(W.partitionBy("mode", "image_id").orderBy("ann_id", "kind"))
    return d.select("dataset", "mode", "image_id", "category_id", "x", "y", "w", "h", "score", place.alias("det_ord"))


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All derived tables and the raw ones they come from; views of the same names exist afterwards."""
    out = {}
    for name in RAW:
        out[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    for name, text in TABLES.items():
        if name == "det_annotations":
            out[name] = _annotations(spark, out["lineitem"])
        else:
            out[name] = _predictions(out["det_annotations"]) if name == "det_predictions" else spark.sql(text)
        out[name].createOrReplaceTempView(name)
    return out


def oracle(sql: str, *tables: str) -> str:
    """DuckDB text: the derived tables that sql needs, in front of it."""
    order = [t for t in TABLES if t in tables or any(t in _NEEDS.get(u, ()) for u in tables)]
    parts = [f"{t} as materialized ({TABLES[t]})" for t in order]
    sql = sql.strip()
    if not parts:
        return sql
    if sql.lower().startswith("with recursive "):
        parts.append(sql[15:].lstrip())
        return "with recursive " + ",\n".join(parts)
    if sql.lower().startswith("with "):
        parts.append(sql[5:].lstrip())
        return "with " + ",\n".join(parts)
    return "with " + ",\n".join(parts) + "\n" + sql
