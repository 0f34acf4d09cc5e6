"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (one machine, as in tests) a temporary one of the application."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    return (got or _one_machine(spark)).rstrip("/")


def _one_machine(spark: SparkSession) -> str:
    """A folder of this machine, which only an application that runs on it alone may use."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return _own(spark.sparkContext.applicationId)


@functools.cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"spark-shared-{application}-")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither recompute it nor need its executors."""
    path = f"{folder(df.sparkSession)}/boxyard-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, _id, _t, text) of a table of texts, null texts as empty ones.

    (_id, _t), the id and a hash of the text, finds a row again in a join. Rows that agree in both are the same row
    twice, and have the same results. Other columns are left behind.
    """
    a, b = row_keys(docs, id_col, text_col)
    return docs.select(docs[id_col].alias("doc_id"), a.alias("_id"), b.alias("_t"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def integer(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are whole numbers, which stand for themselves in row_keys()."""
    return docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The columns _id and _t of keyed(): integer ids stand for themselves, other ids are hashed, null is the least number."""
    own = docs[id_col].cast("long") if integer(docs, id_col) else F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col].cast("string")))
    return F.coalesce(own, F.lit(-(2**63))), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
