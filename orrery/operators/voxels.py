"""Fields on voxels, their smoothing, surfaces and craters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm
from .neighbors import pairs
from .quantiles import quantiles

# Constants of metal units (angstrom, ps, eV, amu).
KINETIC = 1.0364269e-4  # amu angstrom^2 / ps^2 in eV
BOLTZMANN = 8.617333262e-5  # eV / K
BAR = 1.602176634e6  # eV / angstrom^3 in bar
GRAM = 1.66053907  # amu / angstrom^3 in g / cm^3


def axis_index(x: Column, low: float, size: float, length: float) -> Column:
    """Voxel index; the last voxel takes what lies on or beyond its upper face."""
    count = -int(-length // size)
    return F.least(F.floor((x - low) / size), F.lit(count - 1)).cast("int")


def edge(index: Column, size: float, length: float) -> Column:
    """A voxel's width along an axis; the last one may be cut off by the box."""
    return F.least(F.lit(size), length - index * size)


def voxel_fields(atoms: DataFrame, size: float, lengths: Sequence[float], mass: Column, low: Sequence[float] = (0.0, 0.0, 0.0), oxygen: int = 2, silicon: int = 1, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """One row for each voxel with atoms, from one grouped sum: density, number_density, vcom_*, temperature (null for
    one atom), pressure (kinetic part of the lab frame and virial about the center), virial_pressure, avg_speed,
    avg_o_speed (null without oxygen) and voxel_type (2 with silicon, else 1)."""
    index = [axis_index(F.col(a), lo, size, n).alias(f"i{a}") for a, lo, n in zip("xyz", low, lengths, strict=True)]
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    speed = F.sqrt(v2)
    sums = atoms.select(*keys, *index, "type", "x", "y", "z", "vx", "vy", "vz", "fx", "fy", "fz", mass.alias("m")).groupBy(*keys, "ix", "iy", "iz").agg(
        F.count("*").alias("n"), F.sum("m").alias("m"), *(F.sum(F.col("m") * F.col(f"v{a}")).alias(f"p{a}") for a in "xyz"), F.sum(F.col("m") * v2).alias("mv2"),
        *(F.sum(F.col("m") * F.col(a)).alias(f"mr{a}") for a in "xyz"), *(F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"), F.sum(sum((F.col(a) * F.col(f"f{a}") for a in "yz"), F.col("x") * F.col("fx"))).alias("rf"),
        F.avg(speed).alias("avg_speed"), F.avg(F.when(F.col("type") == oxygen, speed)).alias("avg_o_speed"), F.max((F.col("type") == silicon).cast("int")).alias("si"),
    )
    volume = edge(F.col("ix"), size, lengths[0]) * edge(F.col("iy"), size, lengths[1]) * edge(F.col("iz"), size, lengths[2])
    vcom = {a: F.col(f"p{a}") / F.col("m") for a in "xyz"}
    thermal = F.col("mv2") - F.col("m") * (vcom["x"] * vcom["x"] + vcom["y"] * vcom["y"] + vcom["z"] * vcom["z"])
    virial = F.col("rf") - sum((F.col(f"mr{a}") / F.col("m") * F.col(f"f{a}") for a in "yz"), F.col("mrx") / F.col("m") * F.col("fx"))
    return sums.select(
        *keys, "ix", "iy", "iz", F.col("n"), (F.col("m") / volume * GRAM).alias("density"), (F.col("n") / volume).alias("number_density"),
        *(vcom[a].alias(f"vcom_{a}") for a in "xyz"), F.when(F.col("n") > 1, thermal * KINETIC / ((3 * F.col("n") - 3) * BOLTZMANN)).alias("temperature"),
        ((F.col("mv2") * KINETIC + virial) / (3 * volume) * BAR).alias("pressure"), (virial / (3 * volume) * BAR).alias("virial_pressure"),
        "avg_speed", "avg_o_speed", F.when(F.col("si") == 1, 2).otherwise(1).alias("voxel_type"),
    )


def box_smooth(voxels: DataFrame, counts: Sequence[int], fields: Sequence[str], reach: int = 3, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Every voxel of the grid with its fields' means over the known values of the cube around it, null without any.

    Sums and weights go through three passes, one for each axis; in each a row is added to the rows it reaches, so the
    cost is three times 2 reach + 1 rows for each voxel.
    """
    names = ["ix", "iy", "iz"]
    sums = voxels.select(*keys, *names, *(F.coalesce(f, F.lit(0.0)).alias(f) for f in fields), *(F.col(f).isNotNull().cast("int").alias(f"w_{f}") for f in fields))
    values = [*fields, *(f"w_{f}" for f in fields)]
    for axis, count in zip(names, counts, strict=True):
        near = F.sequence(F.greatest(F.col(axis) - reach, F.lit(0)), F.least(F.col(axis) + reach, F.lit(count - 1)))
        others = [c for c in names if c != axis]
        sums = sums.withColumn(axis, F.explode(near)).groupBy(*keys, *others, axis).agg(*(F.sum(v).alias(v) for v in values))
    return sums.select(*keys, *names, *(F.try_divide(F.col(f), F.col(f"w_{f}")).alias(f) for f in fields))


def surface(atoms: DataFrame, size: float, lengths: Sequence[float], low: Sequence[float] = (0.0, 0.0, 0.0), silicon: int = 1) -> DataFrame:
    """(frame, iy, iz, height, ix): the highest silicon in each column along x and its voxel."""
    index = [axis_index(F.col(a), low[k], size, lengths[k]).alias(f"i{a}") for k, a in ((1, "y"), (2, "z"))]
    top = atoms.filter(F.col("type") == silicon).groupBy("frame", *index).agg(F.max("x").alias("height"))
    return top.withColumn("ix", axis_index(F.col("height"), low[0], size, lengths[0]))


def jet_tip(fields: DataFrame, size: float, fastest: float = 30.0) -> DataFrame:
    """(frame, tip): middle of the farthest voxel along x with water (no silicon) faster than given; before smoothing."""
    fast = fields.filter((F.col("voxel_type") == 1) & (F.col("avg_speed") > fastest))
    return fast.groupBy("frame").agg(((F.max("ix") + 0.5) * size).alias("tip"))


def hydronium(atoms: DataFrame, size: float, low: float, center: tuple[float, float], radius: float, reach: float = 1.2, pad: float = 1.3, oxygen: int = 2, hydrogen: int = 3) -> DataFrame:
    """(frame, ix, n): oxygens in a rod along x with three hydrogens or more within reach, by slabs; no periodicity."""
    off = norm(F.col("y") - center[0], F.col("z") - center[1])
    rod = atoms.filter((F.col("type") == oxygen) & (off <= radius) | (F.col("type") == hydrogen) & (off <= radius + pad))
    near = pairs(rod, reach, (1.0, 1.0, 1.0), periodic=(False, False, False), center=F.col("type") == oxygen, wing=F.col("type") == hydrogen, carry=("x",))
    full = near.groupBy("frame", "i", "x_i").agg(F.count("*").alias("h")).filter("h >= 3")
    return full.groupBy("frame", F.floor((F.col("x_i") - low) / size).cast("int").alias("ix")).agg(F.count("*").alias("n"))


def crater(heights: DataFrame, undisturbed: Column, least_depth: float) -> DataFrame:
    """(frame, reference, median, bins, deepest): the reference plane is the mean of undisturbed columns; bins lie
    deeper than given below it."""
    plane = heights.groupBy("frame").agg(F.avg(F.when(undisturbed, F.col("height"))).alias("reference"))
    plane = plane.join(quantiles(heights, "height", [0.5], ["frame"]).select("frame", F.col("q")[0].alias("median")), "frame", "left")
    depth = F.col("reference") - F.col("height")
    return heights.join(plane, "frame").groupBy("frame", "reference", "median").agg(F.count_if(depth > least_depth).alias("bins"), F.max(depth).alias("deepest"))


def sphere_fit(points: DataFrame, center: tuple[float, float], residual: float | None = None, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, cx, radius): sphere with its center on a line along x, by regression of -(x^2 + d^2) on x.

    With `residual`, points farther than this from the first sphere are left out and it is fitted again. Points of one
    x give nulls.
    """
    d2 = (F.col("y") - center[0]) * (F.col("y") - center[0]) + (F.col("z") - center[1]) * (F.col("z") - center[1])

    def fit(rows: DataFrame) -> DataFrame:
        y = -(F.col("x") * F.col("x") + d2)
        line = rows.groupBy(*keys).agg(F.regr_slope(y, "x").alias("slope"), F.regr_intercept(y, F.col("x")).alias("c0"))
        cx = -F.col("slope") / 2
        return line.select(*keys, cx.alias("cx"), F.sqrt(F.greatest(cx * cx - F.col("c0"), F.lit(0.0))).alias("radius"))

    first = fit(points)
    if residual is None:
        return first
    off = F.abs(F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + d2) - F.col("radius"))
    return fit(points.join(first, list(keys)).filter(off <= residual).drop("cx", "radius"))


def first_hit(voxels: DataFrame, kind: int = 2) -> DataFrame:
    """(frame, iy, iz, ix): the first voxel of a kind along x in each column."""
    return voxels.filter(F.col("voxel_type") == kind).groupBy("frame", "iy", "iz").agg(F.min("ix").alias("ix"))


def display_range(values: DataFrame, field: str, clip: float = 1.0, keys: Sequence[str] = ("frame",), zero_based: bool = False) -> DataFrame:
    """(keys, lo, hi): percentiles clip and 100 - clip of a field, the lower one 0 if asked."""
    found = quantiles(values, field, [clip / 100, 1 - clip / 100], keys)
    return found.select(*keys, (F.lit(0.0) if zero_based else F.col("q")[0]).alias("lo"), F.col("q")[1].alias("hi"))


def normalized(values: DataFrame, field: str, limits: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The field brought to [0, 1] between its limits, clipped."""
    share = F.try_divide(F.col(field) - F.col("lo"), F.col("hi") - F.col("lo"))
    return values.join(limits, list(keys)).withColumn(field, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("lo", "hi")


def magnitude(fields: DataFrame) -> DataFrame:
    """Adds vcom, the length of the voxels' velocity."""
    return fields.withColumn("vcom", norm(F.col("vcom_x"), F.col("vcom_y"), F.col("vcom_z")))


