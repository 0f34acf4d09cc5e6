"""Chat formatting: for every participant of a dialogue, the dialogue as that participant would have to continue it.

The chosen speaker becomes `assistant`, everybody else a named `user`, and only the chosen speaker's words are
trained on. `system` turns stay `system` and are nobody's perspective. One output row is one rendered turn, so a
dialogue of any length never has to be gathered in one place; `segment` strings in the order of `turn,
turn_key, turn_seq` make up the rendered dialogue.

Defined results: a null speaker is the participant `unknown`; a null text is empty; rows without a conversation id
form one dialogue of their own (ids are compared null-safe). Repeated rows (same conversation, turn, speaker and text)
are kept, each as a segment, numbered by `turn_seq`; turns with one number follow by `turn_key`, their speaker and text. A dialogue with system turns only has no perspective and gives no
row. Extra columns are ignored. `<|` inside a text is written `< |`, so a text cannot close its own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat_name(speaker: Column) -> Column:
    """A name of `[A-Za-z0-9_-]`; a speaker that has other characters gets a short hash, so that names stay distinct."""
    safe = F.regexp_replace(speaker, "[^A-Za-z0-9_-]", "_")
    return F.when(safe == speaker, speaker).otherwise(F.concat(safe, F.lit("_"), F.substring(F.sha2(speaker, 256), 1, 8)))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """Rows (conv_id, perspective, turn, turn_key, turn_seq, out_role, out_name, segment, mask_start, mask_end, trained).

    mask_start and mask_end are the characters of `segment` that carry loss (0, 0 for turns of others): the words and
    the end mark of the chosen speaker, not the header.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("_who"), F.coalesce(F.col(text_col), F.lit("")).alias("_said"),
    )
    people = t.where(F.col("_who") != system).select(F.col("conv_id").alias("_conv"), F.col("_who").alias("perspective")).distinct()
    # copies of one turn are counted first, so that numbering them needs no window over a conversation
    t = t.groupBy("conv_id", "turn", "_who", "_said").agg(F.count(F.lit(1)).alias("_n"))
    d = t.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    mine = F.col("_who") == F.col("perspective")
    role = F.when(F.col("_who") == system, F.lit(system)).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(role == "user", chat_name(F.col("_who")))
    # a key and no numbering: the turns that share a number may be very many
    key = F.concat("_who", F.lit(" "), F.sha2("_said", 256))
    d = d.select("conv_id", "perspective", "turn", key.alias("turn_key"), "_n", role.alias("out_role"), name.alias("out_name"), mine.alias("trained"), F.replace(F.col("_said"), F.lit("<|"), F.lit("< |")).alias("_said"))
    head = F.concat(F.lit("<|im_start|>"), F.col("out_role"), F.when(F.col("out_name").isNotNull(), F.concat(F.lit(" name="), F.col("out_name"))).otherwise(F.lit("")), F.lit("\n"))
    d = d.withColumn("_head", head).withColumn("segment", F.concat("_head", "_said", F.lit("<|im_end|>\n")))
    d = d.select(
        "conv_id", "perspective", "turn", "turn_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("turn_seq"), "out_role", "out_name", "segment",
        F.when(F.col("trained"), F.char_length("_head")).otherwise(F.lit(0)).cast("long").alias("mask_start"),
        F.when(F.col("trained"), F.char_length("segment") - 1).otherwise(F.lit(0)).cast("long").alias("mask_end"), "trained",
    )
    return d


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, 'unknown') as who, coalesce(text, '') as said from conversations),
people as (select distinct conv_id, who as perspective from t where who <> 'system'),
n as (select conv_id, turn, who, said, count(*) as n from t group by all),
d as (select n.conv_id, p.perspective, n.turn, who || ' ' || sha256(said) as turn_key, unnest(range(1, n.n + 1)) as turn_seq, who = perspective as trained,
             case when who = 'system' then 'system' when who = perspective then 'assistant' else 'user' end as out_role,
             case when who <> 'system' and who <> perspective then
               case when regexp_replace(who, '[^A-Za-z0-9_-]', '_', 'g') = who then who
                    else regexp_replace(who, '[^A-Za-z0-9_-]', '_', 'g') || '_' || substr(sha256(who), 1, 8) end end as out_name,
             replace(said, '<|', '< |') as said
      from n join people p on n.conv_id is not distinct from p.conv_id),
h as (select *, '<|im_start|>' || out_role || coalesce(' name=' || out_name, '') || chr(10) as head from d)
select conv_id, perspective, turn, turn_key, cast(turn_seq as bigint) as turn_seq, out_role, out_name, head || said || '<|im_end|>' || chr(10) as segment,
       cast(case when trained then length(head) else 0 end as bigint) as mask_start,
       cast(case when trained then length(head || said || '<|im_end|>') else 0 end as bigint) as mask_end, trained
from h
"""
