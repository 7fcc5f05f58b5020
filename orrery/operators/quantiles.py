"""Exact quantiles of doubles by selection, digit by digit, instead of by a map of all distinct values.

A double's bits, with the sign put right, sort like the double itself. They are read as four digits of 16 bits; a pass
counts one digit of the values that share the digits found so far, so no task holds more than 65536 counts a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = [f"_d{k}" for k in range(4)]
SIGN = np.uint64(1 << 63)


def digits_of(values: np.ndarray) -> list[np.ndarray]:
    """Four digits of each double, the first the most significant, that sort like the doubles; -0 is 0."""
    bits = (values + 0.0).view(np.uint64)
    order = np.where(bits & SIGN, ~bits, bits | SIGN)
    return [((order >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int32) for k in range(4)]


def value_of(digits: Sequence[np.ndarray]) -> np.ndarray:
    """The doubles of four digits."""
    order = np.zeros(len(digits[0]), np.uint64)
    for k, d in enumerate(digits):
        order |= d.astype(np.uint64) << np.uint64(48 - 16 * k)
    return np.where(order & SIGN, order ^ SIGN, ~order).view(np.float64)


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), name: str = "q") -> DataFrame:
    """(keys, <name>): array of the exact quantiles, interpolated between the two values around each place.

    Null values and NaN take no part; a group without values has no row. Groups may be of any size and number.
    """
    types = dict(rows.dtypes)
    made = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = digits_of(batch.column("_v").to_numpy(zero_copy_only=False).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *map(pa.array, found)], [*keys, *DIGITS])

    digits = made.mapInArrow(split, ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{d} int" for d in DIGITS)]))
    places = F.array(*(F.struct(F.lit(k).alias("_t"), F.lit(float(s)).alias("_s")) for k, s in enumerate(shares)))
    sizes = made.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 0")
    at = sizes.select(*keys, "_n", F.explode(places).alias("_p")).select(*keys, F.col("_p._t").alias("_t"), (F.col("_p._s") * (F.col("_n") - 1)).alias("_at"))
    ends = F.array(F.struct(F.lit(0).alias("_e"), F.floor("_at").alias("_r")), F.struct(F.lit(1).alias("_e"), F.ceil("_at").alias("_r")))
    sought = at.select(*keys, "_t", "_at", F.explode(ends).alias("_x")).select(*keys, "_t", "_at", "_x._e", F.col("_x._r").cast("long").alias("_r"))
    for k in range(len(DIGITS)):
        known, digit = [*keys, *DIGITS[:k]], DIGITS[k]
        some = digits.join(sought.select(*known).distinct(), known, "left_semi") if k else digits
        counts = some.groupBy(*known, digit).agg(F.count("*").alias("_c"))
        below = F.sum("_c").over(Window.partitionBy(*known).orderBy(digit)) - F.col("_c")  # at most 65536 rows a window
        counts = counts.withColumn("_b", below)
        met = sought.join(counts, known) if known else sought.crossJoin(counts)
        sought = met.filter((F.col("_r") >= F.col("_b")) & (F.col("_r") < F.col("_b") + F.col("_c"))).withColumn("_r", F.col("_r") - F.col("_b")).drop("_b", "_c")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = value_of([batch.column(d).to_numpy(zero_copy_only=False) for d in DIGITS])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "_t", "_e", "_at")), pa.array(found)], [*keys, "_t", "_e", "_at", "_v"])

    found = sought.select(*keys, "_t", "_e", "_at", *DIGITS).mapInArrow(joined, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_t int, _e int, _at double, _v double"]))
    each = found.groupBy(*keys, "_t", "_at").agg(F.max(F.when(F.col("_e") == 0, F.col("_v"))).alias("_lo"), F.max(F.when(F.col("_e") == 1, F.col("_v"))).alias("_hi"))
    share = F.col("_at") - F.floor("_at")
    one = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * (1 - share) + F.col("_hi") * share)
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", one.alias("v")))), lambda x: x["v"]).alias(name)).filter(F.size(name) > 0)
