"""Structures: bonds, faces, silanol groups, comparisons, and repairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.geometry import AXES, dot, lattice_image, lattice_parameters, triclinic_image
from ..sources.shared import stored
from .neighbors import HELD_PAIRS, Blocks, Box, nearest, pairs, partner_distances
from .quantiles import quantiles
from .ranks import ranked

DENSITY = 1.6605  # amu / angstrom^3 in g / cm^3, as rounded by convention


def subset(atoms: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Atoms inside a closed box; coordinates aren't shifted."""
    if any(a >= b for a, b in zip(low, high, strict=True)):
        raise ValueError("each lower bound must be below the upper one")
    for axis, a, b in zip(AXES, low, high, strict=True):
        atoms = atoms.filter(F.col(axis).between(a, b))
    return atoms


def region_density(atoms: DataFrame, mass: Column, low: Sequence[float] | None = None, high: Sequence[float] | None = None, where: str | None = None, volume: float | None = None, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, atoms, density): mass in a region by its volume; null for a volume of 0 or less.

    The region is a box, or a free SQL predicate with a volume given; not both.
    """
    if where is not None:
        if low is not None or high is not None or volume is None:
            raise ValueError("a predicate takes a volume and no bounds")
        inside = atoms.filter(F.expr(where))
    else:
        inside = subset(atoms, low, high)
        volume = (high[0] - low[0]) * (high[1] - low[1]) * (high[2] - low[2])
    return inside.groupBy(*keys).agg(F.count("*").alias("atoms"), (F.sum(mass) / F.lit(volume if volume > 0 else None) * DENSITY).alias("density"))


def sphere(atoms: DataFrame, center: Sequence[float], inner: float, outer: float | None = None) -> DataFrame:
    """Atoms farther from a point than `inner`, and no farther than `outer` if given: a carve, or a shell."""
    d = [F.col(a) - c for a, c in zip(AXES, center, strict=True)]
    r = F.sqrt(dot(d, d))
    return atoms.filter((r > inner) & (r <= outer) if outer is not None else r > inner)


def mirror(atoms: DataFrame, axis: str, box: Sequence[tuple[float, float]], velocities: bool = True, flags: Sequence[str] = ()) -> DataFrame:
    """Atoms mirrored along an axis, with the box moved to begin at 0; velocities and image flags of that axis flip."""
    for a, (low, high) in zip(AXES, box, strict=True):
        atoms = atoms.withColumn(a, high - F.col(a) if a == axis else F.col(a) - low)
    flips = ([f"v{axis}"] if velocities else []) + [f"i{a}" for a in flags if a == axis]
    return atoms.withColumns({c: -F.col(c) for c in flips})


def rotate_y(atoms: DataFrame, box: Sequence[tuple[float, float]], velocities: bool = True) -> DataFrame:
    """Atoms turned by +90 degrees about y, with the box moved to begin at 0: x' = z - zlo, y' = y - ylo, z' = xhi - x."""
    (_, xhi), (ylo, _), (zlo, _) = box
    turned = {"x": F.col("z") - zlo, "y": F.col("y") - ylo, "z": xhi - F.col("x")}
    if velocities:
        turned |= {"vx": F.col("vz"), "vz": -F.col("vx")}
    return atoms.withColumns(turned)


def shift(atoms: DataFrame, chosen: Column, axis: str, length: float) -> DataFrame:
    """Chosen atoms moved along an axis."""
    return atoms.withColumn(axis, F.col(axis) + F.when(chosen, float(length)).otherwise(0.0))


def refit(atoms: DataFrame, pad: float, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Atoms moved so that each axis begins at `pad`, with the box lengths lx, ly, lz that leave the same at the end."""
    ends = atoms.groupBy(*keys).agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    out = atoms.join(ends, list(keys))
    out = out.withColumns({f"l{a}": F.col(f"hi_{a}") - F.col(f"lo_{a}") + 2 * pad for a in AXES} | {a: F.col(a) - F.col(f"lo_{a}") + pad for a in AXES})
    return out.drop(*(f"{n}_{a}" for a in AXES for n in ("lo", "hi")))


def crossing_bonds(half: DataFrame, box: Sequence[float], areas: Sequence[float]) -> DataFrame:
    """(frame, face, pair, n, per_area): bonds that cross each periodic face, by kinds.

    half: bonds with i < j whose plain displacement (rx, ry, rz) still holds the crossing.
    """
    _, images = triclinic_image([F.col("rx"), F.col("ry"), F.col("rz")], [F.lit(float(x)) for x in box])
    kinds = F.concat_ws("-", F.least("type_i", "type_j").cast("string"), F.greatest("type_i", "type_j").cast("string"))
    faces = F.explode(F.array(*(F.struct(F.lit(n).alias("face"), F.abs(k).cast("long").alias("count"), F.lit(float(a)).alias("area")) for n, k, a in zip(AXES, images, areas, strict=True))))
    rows = half.select("frame", kinds.alias("pair"), faces.alias("f")).select("frame", "pair", "f.*").filter("count > 0")
    return rows.groupBy("frame", "face", "pair").agg(F.sum("count").alias("n"), (F.sum("count") / F.first("area")).alias("per_area"))


def silanol(atoms: DataFrame, box: Box, si_o: float, o_h: float, pad: float = 0.0, surface: float | None = None, silicon: int = 1, oxygen: int = 2, hydrogen: int = 3, silicons: DataFrame | None = None) -> DataFrame:
    """(frame, atom_id, silicon_id): oxygens with exactly one silicon and a hydrogen, within the silicons' padded extent
    along x; with `surface`, only those whose silicon lies within this of the extent's ends, and with `silicons` (frame,
    atom_id), only those whose silicon is one of these."""
    near = pairs(atoms, max(si_o, o_h), box, center=F.col("type") == oxygen, wing=F.col("type").isin(silicon, hydrogen), carry=("type", "x"))
    si, h = (F.col("type_j") == silicon) & (F.col("r") <= si_o), (F.col("type_j") == hydrogen) & (F.col("r") <= o_h)
    each = near.groupBy("frame", "i", "x_i").agg(F.count_if(si).alias("si"), F.count_if(h).alias("h"), F.max(F.when(si, F.struct(F.col("j"), F.col("x_j")))).alias("s"))
    extent = atoms.filter(F.col("type") == silicon).groupBy("frame").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    found = each.filter((F.col("si") == 1) & (F.col("h") >= 1)).join(extent, "frame").filter(F.col("x_i").between(F.col("lo") - pad, F.col("hi") + pad))
    if surface is not None:
        found = found.filter((F.col("s.x_j") <= F.col("lo") + surface) | (F.col("s.x_j") >= F.col("hi") - surface))
    found = found.select("frame", F.col("i").alias("atom_id"), F.col("s.j").alias("silicon_id"))
    if silicons is None:
        return found
    return found.join(silicons.select("frame", F.col("atom_id").alias("silicon_id")).distinct(), ["frame", "silicon_id"], "left_semi").select(*found.columns)


def count_statistics(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median, population variance and deviation, standard error, extremes and quartiles of counts."""
    agg = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most")]
    if dict(counts.dtypes)[value] in ("double", "float"):  # distinct values without bound
        q = quantiles(counts, value, [0.25, 0.5, 0.75], keys)
        out = counts.groupBy(*keys).agg(*agg)
        out = out.join(q, list(keys), "left") if keys else out.join(q, F.lit(True), "left")
    else:
        out = counts.groupBy(*keys).agg(*agg, F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return out.select(*keys, "n", "mean", F.col("q")[1].alias("median"), "variance", "deviation", (F.col("deviation") / F.sqrt("n")).alias("sem"), "least", "most", (F.col("most") - F.col("least")).alias("span"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def coordination(atoms: DataFrame, near: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, atom_id, n): neighbours of every atom, 0 for those without."""
    counts = near.groupBy(*keys, F.col("i").alias("atom_id")).agg(F.count("*").alias("n"))
    return atoms.select(*keys, "atom_id").join(counts, [*keys, "atom_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shortest(near: DataFrame, k: int = 5) -> DataFrame:
    """(type_i, type_j, rank, r): the k shortest distances of each unordered pair of kinds; near holds i < j."""
    rows = near.select(F.least("type_i", "type_j").alias("type_i"), F.greatest("type_i", "type_j").alias("type_j"), "r", "frame", "i", "j")
    order = Window.partitionBy("type_i", "type_j").orderBy("r", "frame", "i", "j")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("type_i", "type_j", "rank", "r")


def compare(a: DataFrame, b: DataFrame, lattice: Sequence[Sequence[float]], mass: Column, by: str = "type") -> DataFrame:
    """(<by>, atoms, msd, rms, mean): displacements from one structure to another by kind, and of all with a null kind.

    Both must hold the same ids, or an error is raised.
    """
    odd = a.select("atom_id").join(b.select("atom_id").withColumn("there", F.lit(1)), "atom_id", "full_outer").filter("there is null").limit(1).count()
    if odd or a.count() != b.count():
        raise ValueError("the structures hold different atoms")
    met = a.select("atom_id", by, *AXES).join(b.select("atom_id", *(F.col(x).alias(f"{x}b") for x in AXES)), "atom_id")
    d = lattice_image([F.col(f"{x}b") - F.col(x) for x in AXES], [[F.lit(float(v)) for v in row] for row in lattice])
    rows = met.withColumn("d2", dot(d, d))
    out = rows.rollup(by).agg(F.count("*").alias("atoms"), F.avg("d2").alias("msd"), F.avg(F.sqrt("d2")).alias("mean"))
    return out.select(by, "atoms", "msd", F.sqrt("msd").alias("rms"), "mean")


def center_shift(a: DataFrame, b: DataFrame, mass: Column) -> DataFrame:
    """(dx, dy, dz): shift of the center of mass between two structures of the same atoms."""
    center = lambda t, s: t.withColumn("m", mass).agg(*((F.sum(F.col("m") * F.col(x)) / F.sum("m")).alias(f"{x}{s}") for x in AXES))
    return center(a, "a").crossJoin(center(b, "b")).select(*((F.col(f"{x}b") - F.col(f"{x}a")).alias(f"d{x}") for x in AXES))


def most_displaced(a: DataFrame, b: DataFrame, box: Box, n: int = 5) -> DataFrame:
    """The n atoms that moved farthest, ties to smaller ids."""
    from ..functions.geometry import minimum_image

    met = a.select("atom_id", *AXES).join(b.select("atom_id", *(F.col(x).alias(f"{x}b") for x in AXES)), "atom_id")
    d = [minimum_image(F.col(f"{x}b") - F.col(x), size) for x, size in zip(AXES, box, strict=True)]
    return met.select("atom_id", F.sqrt(dot(d, d)).alias("moved")).orderBy(F.desc("moved"), "atom_id").limit(n)


def stoichiometry(before: DataFrame, after: DataFrame, silicon: int = 1, oxygen: int = 2, hydrogen: int = 3) -> DataFrame:
    """(deficit, silicon_lost): 2 dO - dH between two structures, positive where hydrogen must go, and lost silicon."""
    count = lambda t, s: t.agg(*(F.count_if(F.col("type") == k).alias(f"{n}{s}") for n, k in (("si", silicon), ("o", oxygen), ("h", hydrogen))))
    return count(before, "0").crossJoin(count(after, "1")).select((2 * (F.col("o0") - F.col("o1")) - (F.col("h0") - F.col("h1"))).alias("deficit"), (F.col("si0") - F.col("si1")).alias("silicon_lost"))


def remove_orphans(before: DataFrame, after: DataFrame, center: Sequence[float], radius: float, thickness: float = 1.0, growth: float = 0.1, tries: int = 5, oxygen: int = 2, hydrogen: int = 3) -> tuple[DataFrame, DataFrame]:
    """(structure, candidates): a carved structure whose composition is balanced again by removing the most isolated atoms
    of the shell around the hole, and the shell's atoms with a KEEP or DELETE tag.

    Missing hydrogen loss takes that many hydrogens; missing oxygen loss half as many oxygens, and one hydrogen more for
    an odd number. The shell grows until it holds enough.
    """
    deficit = stoichiometry(before, after).first()["deficit"]
    want_h = deficit if deficit > 0 else -deficit % 2
    want_o = 0 if deficit > 0 else -deficit // 2
    frame = after if "frame" in after.columns else after.withColumn("frame", F.lit(0))
    d = [F.col(a) - c for a, c in zip(AXES, center, strict=True)]
    r = F.sqrt(dot(d, d))
    widths = [thickness + k * growth for k in range(tries + 1)]
    counts = frame.agg(*(F.count_if((F.col("type") == kind) & (r > radius) & (r <= radius + w)).alias(f"{n}{k}") for k, w in enumerate(widths) for n, kind in (("o", oxygen), ("h", hydrogen)))).first()
    width = next((w for k, w in enumerate(widths) if counts[f"o{k}"] >= want_o and counts[f"h{k}"] >= want_h), widths[-1])
    shell = sphere(frame, center, radius, radius + width)
    taken = []
    gone = frame.limit(0).select("atom_id")
    for kind, other, n in ((oxygen, hydrogen, want_o), (hydrogen, oxygen, want_h)):
        rest = frame.filter(F.col("type") == other).join(gone, "atom_id", "left_anti")
        far = stored(partner_distances(shell.filter(F.col("type") == kind), rest, width))
        order = ranked(far, [F.desc("distance"), "atom_id"]).filter(F.col("place") <= int(n)).select("atom_id")
        gone = gone.unionByName(order)
        taken.append(far)
    tags = taken[0].unionByName(taken[1]).join(gone.withColumn("tag", F.lit("DELETE")), "atom_id", "left").withColumn("tag", F.coalesce("tag", F.lit("KEEP")))
    return after.join(gone, "atom_id", "left_anti"), tags.select("atom_id", "distance", "tag").orderBy(F.desc("distance"), "atom_id")


def free_atoms(atoms: DataFrame, cutoff: float, box: Box, periodic: Sequence[bool]) -> DataFrame:
    """(frame, atom_id) of atoms without any neighbour."""
    near = pairs(atoms, cutoff, box, periodic=periodic)
    return atoms.select("frame", "atom_id").join(near.select("frame", F.col("i").alias("atom_id")).distinct(), ["frame", "atom_id"], "left_anti")


def repair_edges(
    atoms: DataFrame, cutoff: float, box: Sequence[float], axis: str = "z", pad: float = 1.0, surface: float | None = None, spare_free: bool = True, refitted: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(structure, report): atoms at a broken periodic face brought back to their neighbours, and checks of each frame.

    Atoms that have no neighbour without periodicity along the axis are moved by a box length: first those of the lower
    half, and no farther than `surface` from the face if given, up; then, of what is free after that, those of the upper
    half down. With spare_free, atoms that are free in the periodic box too stay where they are. With refitted, the atoms
    are moved along so that the box begins at 0 and leaves `pad` at both ends; lx, ly, lz are the box's lengths.

    report: (frame, moved_up, moved_down, new_free, moved_twice, low, high, ok). new_free: atoms that are free in the
    repaired structure and weren't in the periodic one; moved_twice: atoms moved up that would be moved down again, and
    aren't; low and high: what is left between the atoms and the box's faces along the axis. A frame is ok if it has
    neither new free atoms nor such that would be moved twice, and both ends are open. Frames without moves have a row too.

    An atom's fate follows from those within three cutoffs of it, and all neighbours that moves by a box length can give
    lie within the cutoff in the periodic box. So one search in blocks that know the atoms around them tells everything.
    Atoms without a place, a frame or an id have no neighbours and are none. Both tables are made when they are asked for.
    """
    k = AXES.index(axis)
    size, half = float(box[k]), float(box[k]) / 2
    low, high = (float("inf"), -float("inf")) if surface is None else (float(surface), size - surface)
    thin = not spare_free and 2 * cutoff > size  # several images may be near: all that are near along the other axes are looked at
    named = atoms.withColumn("_at", F.col(axis))
    there = F.coalesce(reduce(lambda a, b: a & b, (F.abs(a) < float("inf") for a in AXES)) & F.col("frame").isNotNull() & F.col("atom_id").isNotNull(), F.lit(False))
    placed, rest = named.filter(there), [c for c in atoms.columns if c not in ("frame", "atom_id")]
    reach = cutoff * (1 + 1e-9)
    blocks = Blocks(placed.withColumn(axis, F.lit(0.0)) if thin else placed, cutoff, box, periodic=[not (thin and j == k) for j in range(3)], carry=("_at", *rest), half=True, halo=3 * reach)
    search, fields = blocks.search, blocks.fields()

    def marks(block: pa.Table) -> tuple[np.ndarray, ...]:
        """(z, up, down, new, twice) of the block's own atoms; z is where they end along the axis."""
        own, z = block.column("_center").to_numpy(), block.column("_at").to_numpy().astype(float)
        place, every = search.placed(block), np.arange(len(z))
        held, n = [], 0
        for part in search.within(place, every, every, reach):
            held.append(part)
            n += len(part[0])
            if n > HELD_PAIRS:
                held = None
                break

        def alone(z: np.ndarray | None) -> np.ndarray:
            """Atoms without a neighbour, in the periodic box or as they lie along the axis."""
            met = np.zeros(len(every), bool)
            for i, j, d, r in held if held is not None else search.within(place, every, every, reach):
                if z is not None:
                    d = d.copy()
                    d[:, k] = z[j] - z[i]
                    r = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
                near = r <= cutoff
                met[i[near]] = met[j[near]] = True
            return ~met

        stay = ~alone(None) if spare_free else np.ones(len(z), bool)
        up = alone(z) & stay & (z <= half) & (z <= low)
        z = z + np.where(up, size, 0.0)
        again = alone(z) & stay & (z > half) & (z >= high)
        down, twice = again & ~up, again & up
        z = z - np.where(down, size, 0.0)
        return tuple(x[own] for x in (z, up, down, alone(z) & stay, twice))

    kept = ["frame", "atom_id", *(c for c in rest if c != axis), "_at"]
    numbers = ("moved_up", "moved_down", "new_free", "moved_twice")

    def counted(block: pa.Table) -> pa.Table:
        z, *found = marks(block)
        some = range(min(len(z), 1))  # a block may hold nothing but atoms of others
        told = {n: pa.array([int(x.sum()) for _ in some], pa.int64()) for n, x in zip(numbers, found, strict=True)}
        told |= {n: pa.array([f(z) for _ in some], pa.float64()) for n, f in (("_low", np.min), ("_high", np.max))}
        return pa.table({"frame": block.column("frame").slice(0, len(some))} | told)

    def moved(block: pa.Table) -> pa.Table:
        _, up, down, *_ = marks(block)
        own = block.filter(block.column("_center"))
        return own.select(kept).append_column("_up", pa.array(up)).append_column("_down", pa.array(down))

    # those without neighbours
    stay, at = F.lit(not spare_free), F.col("_at")
    lone = named.filter(~there).withColumn("_up", F.coalesce(stay & (at <= half) & (at <= low), F.lit(False)))
    raised = at + F.when(F.col("_up"), size).otherwise(0.0)
    lone = lone.withColumn("_again", F.coalesce(stay & (raised > half) & (raised >= high), F.lit(False))).withColumn("_down", F.col("_again") & ~F.col("_up"))
    final = at + F.when(F.col("_up"), size).otherwise(0.0) - F.when(F.col("_down"), size).otherwise(0.0)
    each = [c.cast("long").alias(n) for n, c in zip(numbers, (F.col("_up"), F.col("_down"), stay, F.col("_again") & F.col("_up")), strict=True)]

    counts = blocks.apply(counted, StructType([fields["frame"], *(StructField(n, LongType()) for n in numbers), *(StructField(n, DoubleType()) for n in ("_low", "_high"))]), ())
    counts = counts.unionByName(lone.select("frame", *each, final.alias("_low"), final.alias("_high")))
    ends = [F.lit(float(pad))] * 2 if refitted else [F.min("_low"), F.lit(size) - F.max("_high")]
    counts = counts.groupBy("frame").agg(*(F.sum(n).alias(n) for n in numbers), *(e.alias(n) for n, e in zip(("low", "high"), ends, strict=True)))
    report = counts.withColumn("ok", (F.col("new_free") == 0) & (F.col("moved_twice") == 0) & (F.col("low") > 0) & (F.col("high") > 0))
    whole = blocks.apply(moved, StructType([*(fields[c] for c in kept), *(StructField(n, BooleanType()) for n in ("_up", "_down"))]), kept)
    whole = whole.unionByName(lone.select(*kept, "_up", "_down")).withColumn(axis, final).select("frame", "atom_id", *rest)
    if refitted:  # dealt by all columns, so that both readers of refit() need them all and share one shuffle behind one search
        whole = whole.repartition(*(f.name for f in whole.schema.fields if isinstance(f.dataType, AtomicType)))
    return (refit(whole, pad) if refitted else whole.withColumns({f"l{a}": F.lit(float(b)) for a, b in zip(AXES, box, strict=True)})), report


def renumbered(atoms: DataFrame, order: str = "atom_id", block: int = 1 << 20) -> DataFrame:
    """(old, new): ids 1, 2, ... in the old order, numbered in blocks of ids whose totals are summed up on their own.

    A block is told by the id alone, so a task that is run again gives the same numbers. The order must be distinct.
    """
    placed = atoms.select(F.col(order).alias("old"), F.floor(F.col(order) / block).alias("_block"))
    totals = placed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each block
    here = F.row_number().over(Window.partitionBy("_block").orderBy("old"))
    return placed.withColumn("_at", here).join(totals.select("_block", before.alias("_before")), "_block").select("old", (F.col("_at") + F.col("_before")).alias("new"))


def cell_changes(before: Sequence[Column], after: Sequence[Column]) -> dict[str, Column]:
    """Relative change of the volume, and the changes of lengths and angles, of two tilted boxes (lx, ly, lz, xy, xz, yz)."""
    volume = lambda b: b[0] * b[1] * b[2]
    a, b = lattice_parameters(*before), lattice_parameters(*after)
    return {"volume_change": (volume(after) - volume(before)) / volume(before)} | {f"d_{k}": b[k] - a[k] for k in a}


def molecule_dipoles(atoms: DataFrame, box: Box, reach: float, charge: float, oxygen: int = 2, hydrogen: int = 3) -> DataFrame:
    """(frame, mx, my, mz, formed, missing): each oxygen's two nearest hydrogens closer than `reach` make a molecule of
    dipole q ((O - H1) - (H2 - O)) by minimum images; oxygens with fewer are missing. Frames without oxygen have no row."""
    near = nearest(pairs(atoms, reach, box, center=F.col("type") == oxygen, wing=F.col("type") == hydrogen, most=2).filter(F.col("r") < reach), 2)
    each = near.groupBy("frame", "i").agg(F.count("*").alias("n"), *(F.sum(f"d{a}").alias(a) for a in AXES))
    whole = atoms.filter(F.col("type") == oxygen).select("frame", F.col("atom_id").alias("i")).join(each, ["frame", "i"], "left")
    full = F.coalesce(F.col("n") == 2, F.lit(False))
    return whole.groupBy("frame").agg(*(F.sum(F.when(full, -charge * F.col(a)).otherwise(0.0)).alias(f"m{a}") for a in AXES), F.count_if(full).alias("formed"), F.count_if(~full).alias("missing"))


def unassigned(atoms: DataFrame, near: DataFrame, hydrogen: int = 3) -> DataFrame:
    """(frame, atom_id) of hydrogens that no molecule took."""
    return atoms.filter(F.col("type") == hydrogen).select("frame", "atom_id").join(near.select("frame", F.col("j").alias("atom_id")).distinct(), ["frame", "atom_id"], "left_anti")


def charge_dipoles(atoms: DataFrame, charge: Column, box: Box) -> DataFrame:
    """(frame, mx, my, mz): sum of q times unwrapped positions, by image flags ix, iy, iz."""
    return atoms.groupBy("frame").agg(*(F.sum(charge * (F.col(a) + F.col(f"i{a}") * size)).alias(f"m{a}") for a, size in zip(AXES, box, strict=True)))
