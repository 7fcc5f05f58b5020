"""Places in an order of all rows, without one task seeing them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Adds each row's place in the order, from 1; the order must be distinct for places to be so, too.

    Rows are sorted by ranges over the tasks and written, which fixes their numbers; the places before a range are the
    sum of the counts of the ranges before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = kept.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    shifts = counts.select("_part", before.alias("_before"))
    return kept.withColumn("_part", part).join(F.broadcast(shifts), "_part").withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_at", "_part", "_before")


def dense(rows: DataFrame, by: Sequence[str], order: str, name: str) -> DataFrame:
    """Adds name: 0, 1, ... for the distinct values of order within each group of `by`, however many they are."""
    steps = ranked(rows.select(*by, order).distinct(), [*by, order], "_place")
    first = steps.groupBy(*by).agg(F.min("_place").alias("_first"))
    numbers = steps.join(first, list(by)).select(*by, order, (F.col("_place") - F.col("_first")).cast("int").alias(name))
    return rows.join(numbers, [*by, order])


def before(rows: DataFrame, key: str, order: str, value: str, name: str = "before", block: int = 1 << 16) -> DataFrame:
    """Adds the value of the row before, in the order of each key; a key of any size is many blocks of rows."""
    placed = ranked(rows, [key, order], "_place").withColumn("_block", F.floor((F.col("_place") - 1) / block))
    here = F.lag(value).over(Window.partitionBy(key, "_block").orderBy("_place"))
    ends = placed.filter(F.col("_place") % block == 0).select(key, (F.col("_block") + 1).alias("_block"), F.col(value).alias("_end"))
    met = placed.withColumn("_here", here).join(ends, [key, "_block"], "left")
    return met.withColumn(name, F.when((F.col("_place") - 1) % block == 0, F.col("_end")).otherwise(F.col("_here"))).drop("_place", "_block", "_here", "_end")
