"""Groups of spelling variants: asymmetric q-chunks find words that are one edit apart.

Two words are near if one inserted, deleted or replaced code point makes them equal. For a comparison at length m, a word of
length m gives two disjoint chunks, its halves. One edit leaves one of the halves as it is, and the same piece then stands in
the other word too, at the same place or shifted by one, since that word has m or m - 1 code points. So the other word gives
its positional grams of the chunk's length; grams further away than the shift can meet no chunk and are not written. Words
that agree on a chunk share a bucket, and are verified there.

A bucket with more than `most` words, or with a long rest, is not compared: its words agree on one half and can differ only in
the rest, so the rest is halved in the same way, and each half of it that stays is a longer chunk. This goes on until a bucket is small, or
until the rest is one code point, when its words are all near. No bucket is dropped, no task holds a large one, and the
words written are at most twice the words of large buckets in each round.

A pair is taken in one bucket only: where the rest holds the first code point in which the two words differ.

Defined results: null and empty texts have no words; ids enter the hash as their text, null ids as empty text; rows that occur
twice count twice; words of any length take part; of near words with equal counts the first in code-point order is the form;
tables without rows give none; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxyard.llm.shared import keep

#: Code points of words, after A-Z became a-z.
LETTERS = "a-zÀ-ÿ"

#: Code points of a rest that is compared.
_REST = 64

#: Distinct words that a task holds before it hands on their counts.
_HELD = 200_000


def _counted(batches: Iterator[pa.RecordBatch], shortest: int, every: int | None) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")
    held: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = runs.findall(text.encode().lower().decode())  # of bytes, only A-Z change
            if every is None:
                held.update(found)
            else:
                begun = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(found).items():
                    h = zlib.crc32(run.encode(), begun)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    held[run] += n
            if len(held) >= _HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with at least `shortest` code points and `least` occurrences, over all texts.

    With `every`, a run whose crc32 of `<id>:<run>` it divides loses one code point first, the one at crc32 % length.
    """
    d = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    counts = d.mapInArrow(lambda b: _counted(b, shortest, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


def _chunk(word: Column, short: Column, length: Column, lo: Column, hi: Column) -> Column:
    """What stays of a word when the rest [lo, hi) is left out; of a word one shorter than `length`, what follows is one place before."""
    return F.xxhash64(length, lo, hi, F.substring(word, F.lit(1), lo), F.substring(word, hi - short + 1, length))


def _halved(d: DataFrame) -> DataFrame:
    """Rows (word, n, short, length, lo, hi) in two: with the left and with the right half of the rest [lo, hi) as the new rest."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    two = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    d = d.withColumn("_r", F.explode(two)).select("word", "n", "short", "length", "_r.lo", "_r.hi")
    return d.withColumn("chunk", _chunk(*[F.col(c) for c in ("word", "short", "length", "lo", "hi")]))


def near_pairs(words: DataFrame, most: int = 64) -> DataFrame:
    """(a, na, b, nb): every pair of near words once, of a table (word, n) of distinct words."""
    size = F.char_length("word")
    sides = F.array(*[F.struct(F.lit(s).alias("short"), (size + s).cast("int").alias("length")) for s in (0, 1)])
    rest = words.withColumn("_s", F.explode(sides)).select("word", "n", "_s.*").select("*", F.lit(0).alias("lo"), F.col("length").alias("hi"))
    found = None
    while True:
        rows = _halved(rest)
        # a bucket without a word of the full length has nothing to compare
        sizes = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("size"), F.min("short").alias("least_short")).where((F.col("size") > 1) & (F.col("least_short") == 0)).select("chunk", "size")
        rows = keep(rows.join(sizes, "chunk"), "buckets")
        span = F.col("hi") - F.col("lo")
        ready = ((F.col("size") <= most) & (span <= _REST)) | (span == 1)
        of = lambda c: [F.col("word").alias(c), F.col("n").alias(f"n{c}"), F.substring("word", F.col("lo") + 1, span - F.col("short")).alias(f"rest_{c}")]  # noqa: E731, B023
        small = rows.where(ready)
        a = small.where("short = 0").select("chunk", "lo", "hi", "length", *of("a"))
        b = small.select("chunk", F.col("short").alias("_short"), *of("b"))
        once = (F.col("_short") == 1) | (F.col("a") < F.col("b"))
        one_edit = F.levenshtein("rest_a", "rest_b", 1) == 1
        prefix = lambda to: F.substring("a", F.lit(1), to) == F.substring("b", F.lit(1), to)
        suffix = F.substring("a", F.col("hi") + 1, F.col("length")) == F.substring("b", F.col("hi") - F.col("_short") + 1, F.col("length"))
        first_here = (F.col("hi") == F.col("length")) | ~prefix(F.col("hi"))
        got = a.join(b, (a["chunk"] == b["chunk"]) & once & one_edit & prefix(F.col("lo")) & suffix & first_here).select("a", "na", "b", "nb")
        got = keep(got, "near")
        found = got if found is None else found.unionByName(got)
        rest = rows.where(~ready).drop("size", "chunk")
        if not rest.limit(1).count():
            return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms (word, form) lead to; every round doubles the steps taken."""
    at = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = keep(at.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        at = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return at


def spelling_variants(words: DataFrame, ratio: int = 10, most: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n).

    form: the near word with the largest n (ties: the first in code-point order) if that is at least ratio * n; root: the
    word that forms lead to in the end, from the word itself on; n_near: the number of near words.
    """
    words = keep(words, "words")
    pairs = near_pairs(words, most)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    d = words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    d = keep(d, "forms")
    return d.join(roots(d.where(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
