"""Summaries and checks of frames, and profiles of the n-th neighbour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamped_acos, closed_bin, dot
from .ranks import before


def frame_summary(atoms: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(frames, least, most, mean) atoms in a frame."""
    counts = atoms.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("frames"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def formula(atoms: DataFrame, element: str = "element", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, formula): element counts like H2 O1, in the elements' order."""
    counts = atoms.groupBy(*keys, element).agg(F.count("*").alias("n"))
    part = F.struct(F.col(element), F.concat(F.col(element).cast("string"), F.col("n").cast("string")).alias("t"))
    return counts.groupBy(*keys).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"])).alias("formula"))


def not_rising(frames: DataFrame, key: str = "traj_id", order: str = "frame", value: str = "timestep") -> DataFrame:
    """Frames whose time step isn't beyond the one before."""
    return before(frames, key, order, value).filter(F.col("before") >= F.col(value))


def merge_checks(parts: DataFrame, merged: DataFrame, expected: int, key: str = "name", order: str = "timestep") -> DataFrame:
    """(check, ok) of the parts of a merged trajectory: their number, empty ones, clashing names, the merged number, and
    strictly rising time steps. parts: (name, frames); merged: (traj_id, frame, timestep)."""
    a = parts.agg(F.count("*").alias("parts"), F.count_if(F.coalesce("frames", F.lit(0)) == 0).alias("empty"), F.count_distinct(key).alias("names"), F.sum("frames").alias("frames"))
    b = merged.agg(F.count("*").alias("merged"))
    c = not_rising(merged).agg(F.count("*").alias("falling"))
    checks = {"count": F.col("parts") == expected, "not_empty": F.col("empty") == 0, "names": F.col("names") == F.col("parts"), "merged_count": F.col("merged") == F.col("frames"), "rising": F.col("falling") == 0}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in checks.items())))
    return a.crossJoin(b).crossJoin(c).select(rows.alias("r")).select("r.*")


def frozen(atoms: DataFrame, axis: str, cutoff: float) -> DataFrame:
    """Adds fixed, which marks atoms below a cutoff along an axis."""
    return atoms.withColumn("fixed", F.col(axis) < cutoff)


def visible(voxels: DataFrame, field: str, kinds: Sequence[int] | None = None, **limits: tuple[int, int]) -> DataFrame:
    """Voxels with a value, of some kinds, within closed index limits such as ix=(0, 5)."""
    out = voxels.filter(F.col(field).isNotNull() & ~F.isnan(field))
    for axis, (low, high) in limits.items():
        out = out.filter(F.col(axis).between(low, high))
    return out.filter(F.col("voxel_type").isin(*kinds)) if kinds is not None else out


def nth_profile(near: DataFrame, rank: int, low: float, high: float, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, n, mean, deviation) of the distances of each atom's n-th neighbour inside (low, high), by frame and, with
    null keys, of all frames."""
    order = Window.partitionBy(*keys, "i").orderBy("r", "j")
    found = near.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") == rank) & (F.col("r") > low) & (F.col("r") < high))
    return found.rollup(*keys).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("deviation"))


def counts_below(near: DataFrame, centers: DataFrame, cutoffs: Sequence[float], keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, below_1, ...): mean number of neighbours of each center closer than each cutoff; centers: (keys, atom_id)."""
    sums = near.groupBy(*keys).agg(*(F.count_if(F.col("r") < c).alias(f"_{k}") for k, c in enumerate(cutoffs, 1)))
    each = centers.groupBy(*keys).agg(F.count("*").alias("_n"))
    return each.join(sums, list(keys), "left").select(*keys, *((F.coalesce(F.col(f"_{k}"), F.lit(0)) / F.col("_n")).alias(f"below_{k}") for k in range(1, len(cutoffs) + 1)))


def ranked_angles(near: DataFrame, first: int, second: int, bins: int = 180, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(bin, n, p): histogram of the angles between each atom's neighbours of two ranks, of unit sum."""
    order = Window.partitionBy(*keys, "i").orderBy("r", "j")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank").isin(first, second))
    take = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    each = ranked.groupBy(*keys, "i").agg(*(take(c, k).alias(f"{c}{k}") for k in (first, second) for c in ("dx", "dy", "dz", "r"))).filter(F.col(f"r{second}").isNotNull())
    cosine = dot([F.col(f"d{a}{first}") for a in "xyz"], [F.col(f"d{a}{second}") for a in "xyz"]) / (F.col(f"r{first}") * F.col(f"r{second}"))
    counts = each.groupBy(closed_bin(F.degrees(clamped_acos(cosine)), 0.0, 180 / bins, bins).alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("bin", "n", (F.col("n") / F.col("total")).alias("p"))


def box_edge(mass: Column, density: Column | float, a: Column | None = None, b: Column | None = None) -> Column:
    """The cubic edge for a mass (amu) and a density (g / cm^3), or the third edge where two are given."""
    volume = mass * 1.6605 / density
    return volume / (a * b) if a is not None and b is not None else F.pow(volume, 1 / 3)
