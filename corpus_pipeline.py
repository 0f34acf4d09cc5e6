"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the rows that it keeps, with the columns
of documents; the last one returns the pieces of training sequences. run() writes each stage's result as Parquet to the
shared folder and reads it back for the next one. No stage can be told in SQL, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxyard.llm import decontaminate, neardup, packing, secrets, shared, toxicity
from boxyard.llm.queries import table, tokenizer_file


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, trained on the labels, calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without their secrets."""
    return secrets.redact_secrets(docs, size_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file(), marks=True)


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("decontamination", benchmark_leaks), ("secrets", secret_scan), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
