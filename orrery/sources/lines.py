"""Numbered lines of files that are split among tasks, and headers carried down to the lines below them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unnumbered(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """(path, block, at, value): lines in the order of `at` within their split of a file, which begins at block; one pass."""
    raw = spark.read.options(**options).text(path, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r$", "").alias("value")).withColumn("at", F.monotonically_increasing_id())


def lines(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """(path, block, n, value): lines numbered from 0 in their file. block is where the line's split of the file begins.

    Lines are numbered within their split, and the splits' totals are summed up on their own, so a file of any size is
    read by many tasks.
    """
    raw = unnumbered(spark, path, **options)
    parts = raw.groupBy("path", "block").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("path", "block", (before - F.col("_first")).alias("_shift"))
    return raw.join(starts, ["path", "block"]).select("path", "block", (F.col("at") + F.col("_shift")).alias("n"), "value")


def blocked(rows: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Rows (path, n, ...) with blocks of line numbers, where they don't have blocks of their file."""
    return rows if "block" in rows.columns else rows.withColumn("block", F.floor(F.col("n") / size))


def carried(rows: DataFrame, value: Column, name: str, keys: Sequence[str] = ("path",), order: str = "n") -> DataFrame:
    """Adds the last value that isn't null at or above each row, within its block and from the blocks before."""
    marked = rows.withColumn("_v", value)
    own = Window.partitionBy(*keys, "block").orderBy(order)
    ends = marked.groupBy(*keys, "block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end"))
    before = F.last("_end", True).over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "block", before.alias("_before"))
    return marked.withColumn("_here", F.last("_v", True).over(own)).join(ends, [*keys, "block"]).withColumn(name, F.coalesce("_here", "_before")).drop("_v", "_here", "_before")
