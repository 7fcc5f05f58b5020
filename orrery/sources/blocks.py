"""Records of many lines that begin with a line telling how many follow.

Whether a line is a header can't be told by its looks: a row of whole numbers, or a comment that is a bare number, looks
like one. It is told by the counts, followed from a file's first line. In each block of a file, where every line would lead
is known from the block alone; between blocks, the few lines that a block before leads to are followed by doubling the
number of blocks that a jump passes, so a file of any size takes a number of steps that is the logarithm of its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import blocked
from .shared import stored


#: Lines of a file that are looked at together: only their numbers and spans are, never their text.
LINES = 1 << 17


def filled(rows: DataFrame) -> DataFrame:
    """Rows (path, n, value) without blank lines, numbered anew within their file, with a block of lines each."""
    some = blocked(rows).filter(F.trim("value") != "")
    totals = some.groupBy("path", "block").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each block
    here = F.row_number().over(Window.partitionBy("path", "block").orderBy("n"))
    return some.withColumn("_here", here).join(totals.select("path", "block", before.alias("_before")), ["path", "block"]).withColumn("n", F.col("_here") - 1 + F.col("_before")).drop("_here", "_before")


def exits(n: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Where each line of a block (numbers in a row) leads beyond it, if it is taken for the first of its record."""
    end = n[-1] + 1
    to = n + span
    while (inside := np.flatnonzero(to < end)).size:
        to[inside] = to[to[inside] - n[0]]
    return to


def apart(entries: DataFrame):
    """Entries grouped like blocks, under names of their own."""
    return entries.select(F.col("path").alias("_path"), F.col("block").alias("_block"), F.col("e").alias("_e")).withColumnRenamed("_e", "e").groupBy("_path", "_block")


def headed(rows: DataFrame, span: Column) -> DataFrame:
    """Adds head: whether a line is reached from the first line of its file.

    rows: (path, block, n, ...), n from 0 in each file. span: how many lines a line and what it opens would take; null, and
    what is less, is 1, so a line that opens nothing is passed over.
    """
    rows = rows.withColumn("_span", F.greatest(F.coalesce(span.cast("bigint"), F.lit(1)), F.lit(1)))
    short = rows.select("path", F.floor(F.col("n") / LINES).alias("block"), "n", "_span")
    begins = short.groupBy("path", "block").agg(F.min("n").alias("e"))
    first = begins.groupBy("path").agg(F.min("e").alias("e"), F.count("*").alias("k"))
    reached = first.select("path", "e")
    if (first.agg(F.max("k")).first()[0] or 0) > 1:
        short = stored(short)

        def leads(block: pa.Table) -> pa.Table:
            block = block.sort_by("n")
            to = np.unique(exits(block.column("n").to_numpy(), block.column("_span").to_numpy()))
            return pa.table({"path": pa.array([block.column("path")[0].as_py()] * len(to), pa.string()), "e": to})

        led = short.groupBy("path", "block").applyInArrow(leads, "path string, e long").distinct()
        entries = led.unionByName(reached).distinct().join(short.select("path", "block", F.col("n").alias("e")), ["path", "e"])

        def onward(block: pa.Table, asked: pa.Table) -> pa.Table:
            block = block.sort_by("n")
            n, e = block.column("n").to_numpy(), asked.column("e").to_numpy()
            to = exits(n, block.column("_span").to_numpy())[e - n[0]] if len(e) else np.zeros(0, np.int64)
            return pa.table({"path": asked.column("_path").cast(pa.string()), "e": e, "to": to})

        jump = stored(short.groupBy("path", "block").cogroup(apart(entries)).applyInArrow(onward, "path string, e long, to long"))
        while jump.limit(1).count():
            more = reached.join(jump, ["path", "e"]).select("path", F.col("to").alias("e"))
            reached = stored(reached.unionByName(more).distinct())
            twice = jump.select("path", F.col("e").alias("to"), F.col("to").alias("next"))
            jump = stored(jump.join(twice, ["path", "to"]).select("path", "e", F.col("next").alias("to")))
    reached = reached.join(short.select("path", "block", F.col("n").alias("e")), ["path", "e"])

    def marked(block: pa.Table, entry: pa.Table) -> pa.Table:
        block = block.sort_by("n")
        n, span = block.column("n").to_numpy(), block.column("_span").to_numpy()
        head = []
        at = int(entry.column("e")[0].as_py() - n[0]) if len(entry) and len(n) else len(n)
        while at < len(n):
            head.append(at)
            at += int(span[at])
        return pa.table({"path": block.column("path").take(pa.array(head, pa.int64())), "n": n[head] if head else n[:0]})

    heads = short.groupBy("path", "block").cogroup(apart(reached)).applyInArrow(marked, "path string, n long").withColumn("head", F.lit(True))
    return rows.drop("_span").join(heads, ["path", "n"], "left").select(*(c for c in rows.columns if c != "_span"), F.coalesce("head", F.lit(False)).alias("head"))
