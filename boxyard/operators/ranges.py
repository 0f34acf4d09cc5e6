"""Order over any number of rows: places and running values by ranges, of which none has to hold a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxyard.sources.tables import keep


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in that order, with _at, which grows with it, and _range, the number of the range that a row is in."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(d.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds pos, a row's place in its group from 0 on in the given order, and total, the rows of the group."""
    d = in_ranges(df, *group, *order)
    counts = d.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy(*group)
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    counts = counts.select(*group, "_range", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("total"))
    return d.join(counts, [*group, "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")
