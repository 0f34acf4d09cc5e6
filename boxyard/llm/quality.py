"""Quality rules: per-text counts and a hashed n-gram log-likelihood ratio (trusted target against raw corpus).

Everything here is DataFrame functions; no Python runs on the executors.

Defined results: a null text has no words; its counts are 0 and it fails the base rule. Texts of one word have
no bigram and are scored on that word alone; texts without words score 0.0. Repeated rows are counted as often as
they occur. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
_TRIM = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+"))


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`_id`, `_text`, and `_h`: a 64-bit hash of each word, in order."""
    d = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return d.withColumn("_h", F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)))


def ngram_buckets(h: Column, buckets: int) -> Column:
    """Hash buckets of all words and of all pairs of neighbouring words."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    n = F.size(h)
    two = F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(one, two)


def ngram_weights(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row `weights array<double>`: for each bucket log p(target) - log p(raw), both with add-one smoothing.

    docs is the raw corpus (every row counts); `trusted` holds the ids of the target documents. The row has `buckets`
    entries whatever the corpus, so it may be sent to every task.
    """
    # the ids grow with the corpus, so both sides are always shuffled, however small they are today
    t = trusted.select(F.col(id_col).alias("_tid")).where(F.col("_tid").isNotNull()).distinct()
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(t.hint("merge"), F.col("_id") == F.col("_tid"), "left")
    d = d.select((F.col("_tid").isNotNull()).cast("int").alias("_target"), F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h"))
    grams = d.select("_target", F.explode(ngram_buckets(F.col("_h"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("n_raw"), F.sum("_target").alias("n_target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    filled = every.join(counts, "b", "left").na.fill(0, ["n_raw", "n_target"])
    joined = filled.agg(F.sort_array(F.collect_list(F.struct("b", "n_raw", "n_target"))).alias("c"), F.sum("n_raw").alias("all_raw"), F.sum("n_target").alias("all_target"))
    ratio = F.transform(
        F.col("c"),
        lambda x: F.log((x["n_target"] + F.lit(1.0)) / (F.col("all_target") + F.lit(float(buckets)))) - F.log((x["n_raw"] + F.lit(1.0)) / (F.col("all_raw") + F.lit(float(buckets)))),
    )
    return joined.select(ratio.alias("weights"))


def base_counts(df: DataFrame) -> DataFrame:
    """Adds to `_id, _text, _h` the counts of the base rules."""
    text = F.col("_text")
    d = df.withColumn("n_words", F.size("_h")).withColumn("_bits", F.ceil(F.log2(F.col("n_words") + F.lit(2.0))).cast("int"))
    # a window is packed as (hash, position); equal windows become neighbours once sorted
    d = d.withColumn(
        "_packed",
        F.when(
            F.col("n_words") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.col("n_words") - 3, F.lit(0))),
                    lambda i: F.call_function("shiftleft", F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")),
                )
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    key = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    same = lambda x, k: (key(x) == key(F.get("_packed", k - 1))) | (key(x) == key(F.get("_packed", k + 1)))
    d = d.withColumn("_again", F.filter("_packed", lambda x, k: F.coalesce(same(x, k), F.lit(False))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    # long texts leave few bits of the hash: what they find is held against the whole hashes
    spot = F.transform("_again", lambda x: x.bitwiseAND(mask).cast("int"))
    d = d.withColumn("_full", F.sort_array(F.transform(spot, lambda i: F.struct(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).alias("w"), i.alias("i")))))
    twin = lambda x, k: (x["w"] == F.get("_full", k - 1)["w"]) | (x["w"] == F.get("_full", k + 1)["w"])
    starts = F.sort_array(F.transform(F.filter("_full", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"].cast("long")))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("c")),
        lambda s, p: F.struct(p.alias("last"), (s["c"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("c")),
        lambda s: s["c"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return d.select(
        "_id", "_h",
        F.col("n_words").cast("long").alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, threshold: float = -0.07, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores and judges every row: base counts, base_failed, llr (mean log ratio per n-gram) and kept.

    `kept` is false where the base rules fail, else whether llr >= threshold. The threshold is a fixed number, so a
    row's verdict depends on nothing but its text and the two multinomials.
    """
    weights = ngram_weights(docs, trusted, buckets, id_col, text_col)
    d = base_counts(_hashed(docs, id_col, text_col)).join(F.broadcast(weights))  # one row of fixed size
    d = d.withColumn("_grams", ngram_buckets(F.col("_h"), buckets))
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get("weights", b))
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    d = d.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(F.size("_grams") > 0, F.round(total / F.size("_grams"), 9)).otherwise(F.lit(0.0)).alias("llr"),
    )
    return d.select("*", (~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))).alias("kept"))
