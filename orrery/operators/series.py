"""Series of samples: averages in windows, dielectric constants, smoothing and peaks."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefactor of (M^2 - M M) / (T V) for dipoles in e angstrom, T in K and V in angstrom^3; 2.56e7 / (1.38 * 8.85).
DIELECTRIC = 2.56e7 / (1.38 * 8.85)
#: e angstrom in debye
DEBYE = 4.80320427

#: Steps in a block of a series, which one task sums up.
BLOCK = 1 << 16
MEANS = [f"{n}{a}" for n in ("m", "q") for a in "xyz"]


def running(rows: DataFrame, keys: Sequence[str] = ("traj_id",), block: int = BLOCK) -> DataFrame:
    """(keys, step, rn, base, sums): the number of each sample in its series, the series' first sample, and sums of all up
    to it, less the first sample, as arrays of six.

    Series are cut into blocks of steps. Samples are numbered and summed up within their block, and the blocks' totals
    are summed up on their own, so a long series is not one task. Without the first sample, sums of squares keep their
    digits where a series is far from 0.
    """
    own = [F.col(f"m{a}").cast("double") for a in "xyz"]
    base = rows.groupBy(*keys).agg(F.min_by(F.array(*own), F.when(F.col("mx").isNotNull() & F.col("my").isNotNull() & F.col("mz").isNotNull(), F.col("step"))).alias("base"))
    cut = rows.select(*keys, "step", F.floor(F.col("step") / block).alias("_block"), *(c.alias(f"m{a}") for a, c in zip("xyz", own, strict=True))).join(base, list(keys))
    cut = cut.withColumns({f"m{a}": F.col(f"m{a}") - F.col("base")[k] for k, a in enumerate("xyz")})
    cut = cut.select("*", *((F.col(f"m{a}") * F.col(f"m{a}")).alias(f"q{a}") for a in "xyz"))
    totals = cut.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{c}") for c in MEANS))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", *(f"_{c}" for c in MEANS))))
    order = Window.partitionBy(*keys, "_block").orderBy("step")
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.select(*keys, "_block", "step", "base", F.row_number().over(order).alias("rn"), *(F.sum(c).over(here).alias(c) for c in MEANS))
    return inside.join(totals, [*keys, "_block"]).select(*keys, "step", (F.col("rn") + F.col("_n")).alias("rn"), "base", F.array(*(F.col(c) + F.col(f"_{c}") for c in MEANS)).alias("sums"))


def means(sums: Column, n: Column | int) -> list[Column]:
    """Means of samples less the base, of their squares, and the base itself."""
    return [*((F.get(sums, F.lit(k)) / n).alias(f"{c}_") for k, c in enumerate(MEANS)), *(F.get("base", F.lit(k)).alias(f"b{a}_") for k, a in enumerate("xyz"))]


def fluctuation(temperature: Column | float = 300.0, volume: Column | float = 1.0) -> dict[str, Column]:
    """Mean square, squared mean and variance (each a third of the sum over axes), the variance in debye^2, and the
    dielectric constant without the 1."""
    third = lambda f: (f("x") + f("y") + f("z")) / 3
    variance = third(lambda a: F.col(f"q{a}_") - F.col(f"m{a}_") * F.col(f"m{a}_"))
    mean = third(lambda a: (F.col(f"b{a}_") + F.col(f"m{a}_")) * (F.col(f"b{a}_") + F.col(f"m{a}_")))
    return {"m2": variance + mean, "mm": mean, "variance": variance, "debye2": variance * DEBYE * DEBYE, "epsilon": variance * DIELECTRIC / (temperature * volume)}


def differences(sums: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """Running sums beside those of `size` samples before (start), null for the first samples."""
    back = sums.select(*keys, (F.col("rn") + size).alias("rn"), F.col("sums").alias("start"))
    return sums.join(back, [*keys, "rn"], "left")


def told(found: DataFrame, keys: Sequence[str], physics: dict) -> DataFrame:
    return found.select(*keys, "step", *(c.alias(n) for n, c in fluctuation(**physics).items()))


def sliding(rows: DataFrame, size: int, keys: Sequence[str] = ("traj_id",), **physics) -> DataFrame:
    """The last `size` samples at each step; none before there are so many. The cost doesn't depend on `size`."""
    found = differences(running(rows, keys), size, keys).filter(F.col("rn") >= size)
    window = F.zip_with("sums", F.coalesce("start", F.array(*[F.lit(0.0)] * 6)), lambda a, b: a - b)
    return told(found.select(*keys, "step", *means(window, size)), keys, physics)


def cumulative(rows: DataFrame, keys: Sequence[str] = ("traj_id",), **physics) -> DataFrame:
    """All samples up to each step."""
    return told(running(rows, keys).select(*keys, "step", *means(F.col("sums"), F.col("rn"))), keys, physics)


def hybrid(rows: DataFrame, size: int, keys: Sequence[str] = ("traj_id",), **physics) -> DataFrame:
    """Cumulative until `size` samples are there, then sliding."""
    window = F.zip_with("sums", F.coalesce("start", F.array(*[F.lit(0.0)] * 6)), lambda a, b: a - b)
    found = differences(running(rows, keys), size, keys).select(*keys, "step", *means(window, F.least("rn", F.lit(size))))
    return told(found, keys, physics)


def binned(rows: DataFrame, size: int, keys: Sequence[str] = ("traj_id",), **physics) -> DataFrame:
    """Each `size` samples on their own, named by their last step; a last bin of fewer is dropped."""
    ends = running(rows, keys).filter(F.col("rn") % size == 0)
    window = F.zip_with("sums", F.coalesce("start", F.array(*[F.lit(0.0)] * 6)), lambda a, b: a - b)
    return told(differences(ends, size, keys).select(*keys, "step", *means(window, size)), keys, physics)


STRATEGIES = {"sliding": sliding, "hybrid": hybrid, "binned": binned, "cumulative": lambda rows, size, keys=("traj_id",), **physics: cumulative(rows, keys, **physics)}


def averaged(rows: DataFrame, strategy: str, size: int, keys: Sequence[str] = ("traj_id",), **physics) -> DataFrame:
    """Averages by the strategy's name."""
    return STRATEGIES[strategy](rows, size, keys=keys, **physics)


def dielectric(rows: DataFrame, temperature: Column | float, volume: Column | float, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    """(keys, n, var_x, var_y, var_z, total, epsilon): variances over a whole series, and their third times the prefactor."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.var_pop(f"m{a}").alias(f"var_{a}") for a in "xyz"))
    total = (F.col("var_x") + F.col("var_y") + F.col("var_z")) / 3
    return out.select("*", total.alias("total"), (total * DIELECTRIC / (temperature * volume)).alias("epsilon"))


def gaussian_smooth(curve: DataFrame, sigma: float, keys: Sequence[str] = ("label",), x: str = "k", y: str = "y") -> DataFrame:
    """Curves on whole-numbered points smoothed by a Gaussian cut off at 4 sigma; edges are mirrored, the last point twice."""
    import math

    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    size = curve.groupBy(*keys).agg(F.max(x).alias("_last"))
    kernel = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w / sum(weights)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True))))
    period = 2 * (F.col("_last") + 1)
    place = F.pmod(F.col(x) + F.col("_k.d"), period)
    rows = curve.join(size, list(keys)).select(*keys, F.col(x).alias("to"), kernel.alias("_k"), x, "_last")
    rows = rows.select(*keys, "to", F.col("_k.w").alias("w"), F.when(place > F.col("_last"), period - 1 - place).otherwise(place).cast("int").alias(x))
    return rows.join(curve.select(*keys, x, y), [*keys, x]).groupBy(*keys, "to").agg(F.sum(F.col("w") * F.col(y)).alias(y)).withColumnRenamed("to", x)


def walls(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(wall, base) of each point: the nearest point before that is higher, -1 if none, and the lowest value from there on.

    A stack holds the points that are lower than all before them; each point is pushed and popped once.
    """
    wall, base = np.full(len(y), -1), y.copy()
    stack: list[int] = []
    lowest: list[float] = []  # the lowest value from the stack's point below up to the point itself
    for i, v in enumerate(y.tolist()):
        low = v
        while stack and y[stack[-1]] <= v:
            stack.pop()
            low = min(low, lowest.pop())
        wall[i] = stack[-1] if stack else -1
        base[i] = low
        stack.append(i)
        lowest.append(low)
    return wall, base


def crossings(x: np.ndarray, y: np.ndarray, tops: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Where the curve last rises through each top's half height before it; it does, as the base on that side is lower.

    Tops are met in order with a stack of points, each lower than all behind it; a binary search finds the last low one.
    """
    out, stack, below = np.full(len(tops), np.nan), [], []
    at = 0
    for i, v in enumerate(y.tolist()):
        if at < len(tops) and tops[at] == i:
            k = bisect.bisect_right(below, halves[at]) - 1
            if k >= 0:
                j = stack[k]
                out[at] = x[j] + (halves[at] - y[j]) / (y[j + 1] - y[j]) * (x[j + 1] - x[j])
            at += 1
        while below and below[-1] >= v:
            below.pop()
            stack.pop()
        below.append(v)
        stack.append(i)
    return out


def peaks(curve: DataFrame, prominence: float, keys: Sequence[str] = ("label",), x: str = "k", y: str = "y") -> DataFrame:
    """(keys, x, y, prominence, left, right, fwhm): maxima of curves with the width at half their prominence.

    A peak's bases are the lowest points on each side up to a higher point; its crossings are interpolated linearly.
    A flat top doesn't count. A curve is one task's work, in time that grows with its points alone, however many peaks
    it has; it must fit into memory. Points with a null are left out.
    """
    types = dict(curve.dtypes)

    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by(x)
        at, v = (table.column(c).to_numpy().astype(float) for c in (x, y))
        tops = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
        bases = [walls(v)[1], walls(v[::-1])[1][::-1]]
        high = v - np.maximum(*bases)
        tops = tops[high[tops] >= prominence]
        half = v[tops] - high[tops] / 2
        left = crossings(at, v, tops, half)
        right = -crossings(-at[::-1], v[::-1], len(v) - 1 - tops[::-1], half[::-1])[::-1]
        rows = table.take(pa.array(tops))
        return pa.table({k: rows.column(k) for k in keys} | {x: rows.column(x), y: rows.column(y), "prominence": high[tops], "left": left, "right": right, "fwhm": right - left})

    shape = ", ".join([*(f"`{c}` {types[c]}" for c in (*keys, x, y)), *(f"{c} double" for c in ("prominence", "left", "right", "fwhm"))])
    rows = curve.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*keys).applyInArrow(found, shape)
