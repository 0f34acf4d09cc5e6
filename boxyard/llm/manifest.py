"""A Merkle manifest of a table of texts, and persistent versions of it in which single rows were tampered with.

The tree of a language is 8-ary over its rows in the order of their ids. It is built in aligned blocks of 8**3 nodes: a
task folds a block to one node, the nodes of all blocks are the leaves of the next round, and so on until one node of each
language is left; the nodes of the languages, in their order, are the leaves of one more tree of the same kind.

Versions are made on the way down. A block gets its context, the siblings of each of its ancestors, which is one row
whatever the number of versions; from it, and from its own levels, a tampered leaf's version copies the leaf's ancestors and
nothing else. All other nodes are those of the tree itself. A version's path leaves its block through the context, so the
versions of the upper levels are made where their leaf is and never meet in one task, although all of them copy the root.

H is sha256, as lowercase hex text, of its inputs joined together; digests enter it as hex text.

Defined results: null values are `-`, which no value is; rows with equal ids are ordered by their leaves, repeated rows
have each a leaf of their own; rows without an id come first and are not tampered with; a null language is a language
of its own and comes first; an empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxyard.llm.shared import keep

WIDTH = 8
#: Levels of a block.
HEIGHT = 3
BLOCK = WIDTH**HEIGHT

_CONTEXT = "array<struct<left:string,right:string>>"


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class BlockTree:
    """The levels of one aligned block: levels[0] are its nodes, levels[-1] is its root if it is folded up to one."""

    def __init__(self, nodes: list[str], height: int):
        self.levels = [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([_h("".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """What stands left and right of a node in its run, and of its ancestors below the block's root."""
        out = []
        for level in self.levels[:-1]:
            run = place // WIDTH * WIDTH
            out.append(("".join(level[run:place]), "".join(level[place + 1 : run + WIDTH])))
            place //= WIDTH
        return out


def copied_path(node: str, siblings: list[tuple[str, str]]) -> list[str]:
    """The ancestors of a node whose value is replaced: the nodes that a version does not share."""
    out = []
    for left, right in siblings:
        node = _h(left + node + right)
        out.append(node)
    return out


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(*parts: Column) -> Column:
    return F.sha2(F.concat(*[_part(p) for p in parts]), 256)


def leaves(docs: DataFrame, every: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tree, leaf, changed): the leaf of each row, and its tampered leaf where `every` divides the crc32 of its id as text."""
    text = docs["text"]
    others = [docs[c] for c in (id_col, "source", "lang", "n_chars")]
    lowered = F.translate(text.cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(docs[id_col].cast("string").cast("binary")) % every == 0
    # bytewise, "-" comes before "=": a null language first
    tree = F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit("-"))
    return docs.select(docs[id_col].alias("doc_id"), tree.alias("tree"), _leaf(*others, text).alias("leaf"), F.when(hit, _leaf(*others, lowered)).alias("changed"))


def placed(nodes: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """Adds pos, a row's place in its tree from 0 on, and total, the rows of its tree.

    Rows are dealt by ranges and counted in each; only the counts of ranges are summed up, so a tree may fill any number
    of ranges. `tie` tells equal rows apart.
    """
    d = keep(nodes.withColumn("tie", F.monotonically_increasing_id()), "unplaced")
    d = d.repartitionByRange(*tree, *order, "tie").sortWithinPartitions(*tree, *order, "tie")
    d = keep(d.drop("tie").withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))
    counts = d.groupBy(*tree, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy(*tree)
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    counts = counts.select(*tree, "_range", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("total"))
    return d.join(counts, [*tree, "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


def _height(total: int) -> int:
    """Levels to fold in a block of a tree with so many nodes."""
    n = 0
    while total > 1 and n < HEIGHT:
        total, n = -(-total // WIDTH), n + 1
    return n


def _folded(total: Column) -> Column:
    for _ in range(HEIGHT):
        total = F.when(total > 1, F.ceil(total / WIDTH)).otherwise(total)
    return total.cast("long")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long")


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by("pos")


def _fold_block(t: pa.Table) -> pa.Table:
    t = _sorted(t)
    root = BlockTree(t.column("node").to_pylist(), _height(t.column("total")[0].as_py())).levels[-1][0]
    return pa.table({"tree": t.column("tree")[:1], "pos": t.column("block")[:1], "node": [root]})


def rounds_of(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, pos, total, node) and the nodes of every round above it; the last has one node for each tree."""
    out = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        low = out[-1]
        up = low.withColumn("block", _block()).select("tree", "block", "pos", "total", "node").groupBy("tree", "block").applyInArrow(_fold_block, "tree string, pos long, node string")
        totals = low.where("pos = 0").select("tree", _folded(F.col("total")).alias("total"))
        out.append(keep(up.join(totals, "tree"), "nodes"))
        for _ in range(HEIGHT):
            most = -(-most // WIDTH) if most > 1 else most
    return out


def _spread(key: tuple, low: pa.Table, above: pa.Table) -> pa.Table:
    """The contexts of a block's nodes: their siblings inside the block, then what the block has got."""
    low = _sorted(low)
    tree = BlockTree(low.column("node").to_pylist(), _height(low.column("total")[0].as_py()))
    rest = above.column("context")[0].as_py()
    contexts = [[{"left": a, "right": b} for a, b in tree.siblings(i)] + rest for i in range(len(low))]
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.table({"tree": low.column("tree"), "pos": low.column("pos"), "context": pa.array(contexts, kind), "subroot": pa.array([above.column("subroot")[0].as_py()] * len(low), pa.string())})


def _meet(low: DataFrame, above: DataFrame, f, schema: str) -> DataFrame:
    """Blocks of nodes with their contexts (tree, pos of the block, context, subroot)."""
    left = low.withColumn("block", _block()).groupBy("tree", "block")
    return left.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(f, schema)


def _contexts(rounds: list[DataFrame], top: DataFrame, stop: int) -> DataFrame:
    """(tree, pos, context, subroot) of the nodes of rounds[stop], from those of the trees' roots (tree, context, subroot)."""
    got = top.withColumn("pos", F.lit(0).cast("long"))
    for low in rounds[-2:stop - 1 if stop else None:-1]:
        got = keep(_meet(low, got, _spread, f"tree string, pos long, context {_CONTEXT}, subroot string"), "contexts")
    return got


_OUT = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_copied long, copied array<string>"


def _versions(root: str):
    """For each leaf of a block: its proof, and the root of its version, if it is tampered with, or of the tree as it is."""

    def of(key: tuple, low: pa.Table, above: pa.Table) -> pa.Table:
        low = _sorted(low)
        leaf = low.column("node").to_pylist()
        tree = BlockTree(leaf, _height(low.column("total")[0].as_py()))
        rest = [(x["left"], x["right"]) for x in above.column("context")[0].as_py()]
        subroot = above.column("subroot")[0].as_py()
        upper = "".join(a + b for a, b in rest)
        proofs, folded, copies = [], [], []
        for place, changed in enumerate(low.column("changed").to_pylist()):
            siblings = tree.siblings(place)
            proofs.append(_h("".join(a + b for a, b in siblings) + upper))
            start = leaf[place] if changed is None else changed
            path = copied_path(start, siblings + rest)
            folded.append(path[-1] if path else start)
            copies.append([] if changed is None else path)
        n = len(leaf)
        return pa.table({
            "doc_id": low.column("doc_id"), "leaf": pa.array(leaf, pa.string()), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()),
            "n_copied": pa.array([len(c) for c in copies], pa.int64()), "copied": pa.array(copies, pa.list_(pa.string())),
        })

    return of


def merkle_manifest(docs: DataFrame, every: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_copied, copied) of every row of docs.

    leaf, subroot, root and the proof (the siblings from the leaf to the root) are those of the table as it is; folded_root is
    computed again from the leaf, the tampered one where there is one, and the siblings. copied: the ancestors that a
    tampered leaf's version does not share, from its parent to the version's root.
    """
    d = keep(placed(leaves(docs, every, id_col), ["tree"], ["doc_id", "leaf"]), "leaves")
    base = d.select("tree", "pos", "total", F.col("leaf").alias("node"))
    rounds = rounds_of(base)
    subroots = rounds[-1].select("tree", "node")
    tops = keep(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["tree"], ["name"]), "subroots")
    upper = rounds_of(tops.select("tree", "pos", "total", "node"))
    one = upper[-1].select("node").first()
    if one is None:  # no rows
        return docs.select(docs[id_col].alias("doc_id"), *[F.lit(None).cast(k).alias(n) for n, k in [x.rsplit(" ", 1) for x in _OUT.format(id="").split(", ")[1:]]])
    none = F.array().cast(_CONTEXT)
    above = _contexts(upper, upper[-1].select("tree", none.alias("context"), F.lit("").alias("subroot")), 0)
    above = above.join(tops, ["tree", "pos"]).select(F.col("name").alias("tree"), "context", F.col("node").alias("subroot"))
    schema = _OUT.format(id=docs.schema[id_col].dataType.simpleString())
    low = d.select("doc_id", "tree", "pos", "total", F.col("leaf").alias("node"), "changed")
    if len(rounds) == 1:  # every tree is a single leaf
        return _meet(low, above.withColumn("pos", F.lit(0).cast("long")), _versions(one["node"]), schema)
    return _meet(low, _contexts(rounds, above, 1), _versions(one["node"]), schema)


#: crc32 of a text's bytes, bit by bit; sha256 levels by recursion. DuckDB.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _sql_part(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar))::varchar || ':' || cast({value} as varchar), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_part(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_levels(name: str, leaves: str) -> str:
    """A recursive table (tree, level, pos, h) over leaves (tree, pos, h), and its rows with what stands left and right of them."""
    return f"""{name}(tree, level, pos, h) as (select tree, 0, pos, h from {leaves} union all
  select tree, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by tree) as n from {name}) where n > 1 group by tree, pos // 8),
{name}_s as (select tree, level, pos, h, pos // 8 as up, count(*) over (partition by tree, level) as n,
  coalesce(string_agg(h, '') over (partition by tree, level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(h, '') over (partition by tree, level, pos // 8 order by pos rows between 1 following and unbounded following), '') as r from {name})"""


ORACLE = f"""
with recursive docs as (select doc_id, coalesce('=' || lang, '-') as tree, {_sql_leaf("text")} as leaf,
  case when {_CRC} % 3 = 0 then {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed from documents),
d as (select *, row_number() over (partition by tree order by doc_id) - 1 as pos from docs), below as (select tree, pos, leaf as h from d),
{_sql_levels("low", "below")},
tops as (select tree as name, '' as tree, row_number() over (order by tree) - 1 as pos, h from low_s where n = 1),
{_sql_levels("high", "tops")},
depth as (select (select max(level) from low_s) as low, (select max(level) from high_s) as high),
path as (select doc_id, leaf, changed, d.tree, list(struct_pack(l := s.l, r := s.r) order by s.level) as p from d join low_s s on s.tree = d.tree and s.n > 1 and s.pos = d.pos // (8 ** s.level)::bigint group by all
  union all select doc_id, leaf, changed, d.tree, [] from d where d.tree in (select tree from below group by tree having count(*) = 1)),
above as (select t.name, t.h, list(struct_pack(l := s.l, r := s.r) order by s.level) filter (where s.n > 1) as p from tops t join high_s s on s.pos = t.pos // (8 ** s.level)::bigint group by t.name, t.h),
whole as (select doc_id, leaf, changed, a.h as subroot, list_concat(path.p, coalesce(a.p, [])) as p, (select h from high_s where n = 1) as root from path join above a on a.name = path.tree),
folded as (select *, list_reduce(list_prepend(coalesce(changed, leaf), list_transform(p, lambda x: x.l || '|' || x.r)), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) as folded_root from whole)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.l || x.r), ''), '')) as proof_sha256, folded_root, folded_root = root as verified,
  case when changed is null then 0 else len(p) end as n_copied from folded
"""
