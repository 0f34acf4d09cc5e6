"""Benchmark decontamination by canonical templates; DataFrame functions only.

A text becomes template tokens: numbers, names and units (after a number) turn into typed placeholders, everything else
into its lower-case letters. A name is a capitalised word, and the first word of a sentence may be one. As capitals get
lost and sentences are cut, every window of `k` tokens has two forms: with its names as placeholders, and with its names
as plain words. Windows of the documents are hash-joined with those of the benchmark items in both forms, so a question
whose numbers or names were changed still matches, and a copy matches in any case of letters.

For every alignment of a document with an item (difference of positions) the slots must then be consistent: one value
of the item always stands for one and the same value of the document, and different ones for different ones; windows
with a slot that breaks this do not count. The share of an item's distinct windows that are left is its coverage; from
`least` on the document is contaminated. Coverage by identical values only tells verbatim copies from re-parameterised ones.

Windows with fewer than `literals` distinct literal tokens are too general and are not used. An item without any usable
window, because it is short or mostly numbers and names, matches verbatim: where all its tokens, values included, stand
in a row.

Documents that cannot match are left alone early, which loses none: of every window of an item its rarest word is taken
(rarest in the documents), and only documents that hold it for enough windows of one item to reach `least` are looked at.

The benchmark is joined by broadcast only if its rows, which are counted first, are at most `broadcast_rows`; beyond that
the same join is shuffled.

Defined results: null texts have no tokens and items without tokens never match. A null item id is an item of
its own; items that occur twice count once. A document row that occurs twice is reported twice. Tables without rows give
no rows, a missing benchmark text or an empty benchmark leaves every document clean. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxyard.llm.shared import keep, keyed, row_keys

#: Units, after a number, that are one slot type.
UNITS = "km|m|cm|mm|mi|miles|ft|feet|inches|kg|g|mg|lb|lbs|pounds|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|usd|eur|dollars|euros|cents|percent|mph|kmh"

_NUM, _NAME, _UNIT = "\u0001", "\u0002", "\u0003"


def _marked(text: Column) -> Column:
    """The text with each slot behind a one-character mark of its type."""
    # a number: digits with inner points and commas
    t = F.regexp_replace(text, r"(?<![\p{L}\p{N}])(\p{N}+(?:[.,]\p{N}+)*)", f"{_NUM}$1")
    t = F.regexp_replace(t, rf"(?i)({_NUM}[0-9.,]+ ?)({UNITS})(?!\p{{L}})", f"$1 {_UNIT}$2")
    # a name: a capital followed by small letters, wherever it stands
    return F.regexp_replace(t, r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)(?!\p{L})", f"{_NAME}$1")


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case; slots keep their mark in front of their value."""
    t = F.btrim(F.regexp_replace(F.lower(_marked(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}.,\u0001-\u0003]+|[.,](?!\p{N})|(?<!\p{N})[.,]", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +"))


def pieces(text: Column) -> Column:
    """The runs of letters and digits of a text, in lower case; every token is made of some of them."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _is_slot(x: Column) -> Column:
    return x < "\u0004"


def _is_name(x: Column) -> Column:
    return F.substring(x, 1, 1) == _NAME


def _value(x: Column) -> Column:
    """A token without its mark."""
    return F.when(_is_slot(x), F.substring(x, 2, 1 << 30)).otherwise(x)


def template(x: Column) -> Column:
    """A token, or the mark alone for a slot."""
    return F.when(_is_slot(x), F.substring(x, 1, 1)).otherwise(x)


def plain_template(x: Column) -> Column:
    """The same, with names as words."""
    return F.when(_is_name(x), _value(x)).otherwise(template(x))


def _windows(df: DataFrame, keep_cols: list[str], k: int) -> DataFrame:
    """Of rows with `tok`: (keep_cols, pos, named, wh, vals), both forms of each window of k tokens, and its tokens."""
    forms = []
    for form, named in ((template, True), (plain_template, False)):
        h = df.where(F.size("tok") >= k).select(*keep_cols, "tok", F.transform(F.transform("tok", form), lambda x: F.xxhash64(x)).alias("h"))
        at = F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)]))
        w = h.select(*keep_cols, "tok", F.posexplode(at).alias("pos", "wh"))
        forms.append(w.select(*keep_cols, "pos", F.lit(named).alias("named"), "wh", F.slice("tok", F.col("pos") + 1, k).alias("vals")))
    return forms[0].unionByName(forms[1])


def _literals(vals: Column, named: Column) -> Column:
    """The distinct tokens of a window that its form takes as they are."""
    return F.array_distinct(F.transform(F.filter(vals, lambda x: ~_is_slot(x) | (~named & _is_name(x))), _value))


def benchmark_windows(items: DataFrame, k: int, literals: int, id_col: str, text_col: str) -> DataFrame:
    """(item, ipos, named, wh, vals, words) of the usable windows."""
    b = items.select(F.col(id_col).alias("item"), tokens(F.col(text_col)).alias("tok")).distinct()
    w = _windows(b, ["item"], k).withColumnRenamed("pos", "ipos").withColumn("words", _literals(F.col("vals"), F.col("named")))
    return w.where(F.size("words") >= literals)


def _whole_items(items: DataFrame, k: int, literals: int, item_id: str, item_text: str) -> DataFrame:
    """(item, tok) of the items without usable windows; marks are gone, as they depend on capitals."""
    b = items.select(F.col(item_id).alias("item"), tokens(F.col(item_text)).alias("tok")).where(F.size("tok") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("tok") - k, F.lit(0)))
    usable = (F.size("tok") >= k) & F.exists(starts, lambda i: F.size(_literals(F.slice("tok", i + 1, k), F.lit(False))) >= literals)
    return b.where(~usable).select("item", F.transform("tok", _value).alias("tok")).distinct()


def _rarest(docs: DataFrame, windows: DataFrame, whole: DataFrame, least: float, broadcast_rows: int) -> DataFrame:
    """(piece, item, whole, n, need): the rarest words of an item's windows, for how many windows each stands, and how many are needed."""
    parts = lambda ws: F.filter(F.flatten(F.transform(ws, lambda x: F.split(x, "[.,]"))), lambda x: x != "")
    # a window that is usable in both forms can match in either: only what is literal in both tells
    w = windows.groupBy("item", "ipos").agg(F.min_by("words", F.size("words")).alias("words"))
    each = keep(w.select("item", "ipos", F.explode(parts(F.col("words"))).alias("piece")).unionByName(whole.select("item", F.lit(-1).alias("ipos"), F.explode(parts(F.col("tok"))).alias("piece"))), "words")
    known = each.select("piece").distinct()
    side = F.broadcast if known.count() <= broadcast_rows else lambda x: x
    often = keep(docs.select(F.explode(F.array_distinct(pieces(F.col("text")))).alias("piece")).join(side(known), "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("often")), "often")
    best = each.join(often, "piece", "left").groupBy("item", "ipos").agg(F.min(F.struct(F.coalesce("often", F.lit(0)), "piece")).alias("best"))
    # texts without usable windows have one row
    best = best.select("item", (F.col("ipos") < 0).alias("whole"), "best.piece")
    need = best.groupBy("item", "whole").agg(F.ceil(F.lit(least) * F.count(F.lit(1)) - 1e-9).alias("need")).withColumnsRenamed({"item": "_i", "whole": "_w"})
    n = best.groupBy("item", "whole", "piece").agg(F.count(F.lit(1)).alias("n"))
    return keep(n.join(need, F.col("item").eqNullSafe(F.col("_i")) & (F.col("whole") == F.col("_w"))).select("piece", "item", "whole", "n", "need"), "rarest")


def suspects(docs: DataFrame, windows: DataFrame, whole: DataFrame, least: float, broadcast_rows: int) -> DataFrame:
    """(_id, _t, text) of the documents that can match an item, each once."""
    rarest = _rarest(docs, windows, whole, least, broadcast_rows)
    side = F.broadcast if rarest.count() <= broadcast_rows else lambda x: x
    # a row that occurs twice counts twice here, which lets more through and loses none
    held = docs.select("_id", "_t", F.explode(F.array_distinct(pieces(F.col("text")))).alias("piece")).join(side(rarest), "piece")
    held = held.groupBy("_id", "_t", "item", "whole").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").select("_id", "_t").distinct()
    # texts are shuffled at every size: the documents found grow with the corpus
    return keep(docs.select("_id", "_t", "text").join(keep(held, "held").hint("merge"), ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"]), "suspects")


def _whole_matches(docs: DataFrame, whole: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """(_id, _t, item) where an item without usable windows stands as a whole; None if there are no such items."""
    b = whole.select("item", F.size("tok").alias("len"), F.xxhash64("tok").alias("wh")).distinct()
    lengths = sorted(r["len"] for r in b.select("len").distinct().collect())
    if not lengths:
        return None
    side = F.broadcast if b.count() <= broadcast_rows else lambda x: x
    d = docs.select("_id", "_t", F.transform(tokens(F.col("text")), _value).alias("tok")).withColumn("len", F.explode(F.lit(lengths))).where(F.size("tok") >= F.col("len"))
    hashes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("tok") - F.col("len") + 1), lambda i: F.xxhash64(F.slice("tok", i, F.col("len")))))
    return d.select("_id", "_t", "len", F.explode(hashes).alias("wh")).join(side(b), ["len", "wh"]).select("_id", "_t", "item").distinct()


def _breaks(pairs: Column) -> Column:
    """Of the slot pairs (iv, dv) of an alignment, those that make it no one-to-one mapping."""
    return F.filter(pairs, lambda x: F.exists(pairs, lambda y: (x["iv"] == y["iv"]) != (x["dv"] == y["dv"])))


def matches(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, literals: int = 3, broadcast_rows: int = 1_000_000, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_id, _t, item, coverage, verbatim) of contaminated documents; docs comes from keyed()."""
    w = keep(benchmark_windows(items, k, literals, item_id, item_text), "benchmark")
    whole = keep(_whole_items(items, k, literals, item_id, item_text), "whole")
    docs = suspects(docs, w, whole, least, broadcast_rows)
    side = F.broadcast if w.count() <= broadcast_rows else lambda x: x
    sizes = w.groupBy("item").agg(F.count_distinct("ipos").alias("n_windows"))
    d = _windows(docs.select("_id", "_t", tokens(F.col("text")).alias("tok")), ["_id", "_t"], k).withColumnRenamed("vals", "dvals").drop("named")
    slots = F.filter(F.zip_with("vals", "dvals", lambda i, x: F.struct(i.alias("iv"), _value(x).alias("dv"))), lambda x: _is_slot(x["iv"]))
    slots = F.transform(slots, lambda x: F.struct(_value(x["iv"]).alias("iv"), x["dv"].alias("dv")))
    found = d.join(side(w.select("item", "ipos", "wh", "vals")), "wh").select("_id", "_t", "item", "ipos", (F.col("pos") - F.col("ipos")).alias("diag"), slots.alias("slots"))
    found = keep(found.distinct(), "leaks")
    # only pairs that could reach the coverage are looked at again
    enough = F.col("n") >= F.lit(least) * F.col("n_windows") - 1e-9
    near = found.groupBy("_id", "_t", "item").agg(F.count_distinct("ipos").alias("n")).join(side(sizes).withColumnRenamed("item", "_i"), F.col("item").eqNullSafe(F.col("_i"))).where(enough).select("_id", "_t", F.col("item").alias("_item"), "n_windows")
    f, g = found.alias("f"), near.alias("g")
    same = (F.col("f._id") == F.col("g._id")) & (F.col("f._t") == F.col("g._t")) & F.col("f.item").eqNullSafe(F.col("g._item"))
    near = keep(f.join(g, same).select("f.*", "g.n_windows"), "near")
    # an alignment has no more windows than its item
    line = near.groupBy("_id", "_t", "item", "diag").agg(_breaks(F.array_distinct(F.flatten(F.collect_set("slots")))).alias("broken"))
    a, b = near.alias("a"), line.alias("b")
    same = (F.col("a._id") == F.col("b._id")) & (F.col("a._t") == F.col("b._t")) & F.col("a.item").eqNullSafe(F.col("b.item")) & (F.col("a.diag") == F.col("b.diag"))
    judged = a.join(b, same).where(~F.arrays_overlap("a.slots", "b.broken")).select("a.*", F.exists("a.slots", lambda x: x["iv"] != x["dv"]).alias("changed"))
    got = judged.groupBy("_id", "_t", "item").agg(F.count_distinct("ipos").alias("n"), F.max("n_windows").alias("n_windows"), F.count_distinct(F.when(~F.col("changed"), F.col("ipos"))).alias("n_same"))
    got = got.where(enough).select("_id", "_t", "item", F.round(F.col("n") / F.col("n_windows"), 6).alias("coverage"), (F.col("n_same") >= F.lit(least) * F.col("n_windows") - 1e-9).alias("verbatim"))
    more = _whole_matches(docs, whole, broadcast_rows)
    return got if more is None else got.unionByName(more.withColumn("coverage", F.lit(1.0)).withColumn("verbatim", F.lit(True)))


def find_contamination(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, literals: int = 3, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, contaminated, item_ids, coverage, reparameterised) of every row of docs.

    item_ids: the items that leaked, sorted; coverage: the largest; reparameterised: an item matched by its template only.
    """
    d = keyed(docs, id_col, text_col)
    m = matches(d, items, k, least, literals, broadcast_rows, item_id, item_text)
    m = m.groupBy("_id", "_t").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("coverage").alias("coverage"), F.bool_or(~F.col("verbatim")).alias("reparameterised"), F.lit(True).alias("contaminated"))
    j = d.select("doc_id", "_id", "_t").join(m.hint("merge"), ["_id", "_t"], "left")
    kind = items.schema[item_id].dataType.simpleString()
    return j.select(
        F.col("doc_id").alias(id_col), F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("item_ids", F.array().cast(f"array<{kind}>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, that no benchmark item leaked into."""
    own = row_keys(docs, id_col, text_col)
    found = matches(keyed(docs, id_col, text_col), items, **options).select(F.col("_id").alias("_i"), F.col("_t").alias("_h")).distinct()
    return docs.join(found.hint("merge"), (own[0] == F.col("_i")) & (own[1] == F.col("_h")), "left_anti")
