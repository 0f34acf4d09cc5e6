"""Tables and files in the folder that all machines of a cluster share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _one_machine(spark: SparkSession) -> str:
    """A folder of this machine, which only an application that runs on it alone may use."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return _own(spark.sparkContext.applicationId)


@functools.cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"spark-tables-{application}-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir; where that is unset (one machine, as in tests) in a temporary folder of the application."""
    got = spark.conf.get("spark.checkpoint.dir", None) or _one_machine(spark)
    return f"{got.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither recompute it nor need its executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
