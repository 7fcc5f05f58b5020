"""Pair and angle distributions and structure factors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.geometry import clamped_acos, closed_bin, dot, shell
from .neighbors import TOGETHER, Blocks, Box, spans


def pair_histogram(near: DataFrame, width: float, by: str = "type") -> DataFrame:
    """(<by>_i, <by>_j, bin, n): counts of ordered pairs by distance."""
    return near.groupBy(f"{by}_i", f"{by}_j", F.floor(F.col("r") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def composition(atoms: DataFrame, by: str = "type", keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, <by>, atoms) counts."""
    return atoms.groupBy(*keys, by).agg(F.count("*").alias("atoms"))


def concentrations(atoms: DataFrame, by: str = "type", first_frame: bool = False) -> DataFrame:
    """Mole fraction of each kind over all frames, or in the first one alone."""
    if first_frame:
        atoms = atoms.crossJoin(atoms.agg(F.min("frame").alias("_first"))).filter(F.col("frame") == F.col("_first"))
    counts = atoms.groupBy(by).agg(F.count("*").alias("atoms"))
    total = counts.agg(F.sum("atoms").alias("total"))
    return counts.crossJoin(total).select(by, "atoms", (F.col("atoms") / F.col("total")).alias("fraction"))


def partial_rdf(histogram: DataFrame, counts: DataFrame, volume: float | Column, width: float, by: str = "type", edge: str = "shell") -> DataFrame:
    """(<by>_i, <by>_j, bin, r, n, g, cn): g(r) and the running coordination number, averaged over frames.

    counts: (frame, <by>, atoms). Frames that lack a kind don't count for its pairs. edge="shell" divides by the
    exact shell volume; "upper" by 4 pi r^2 dr at the bin's upper edge.
    """
    a, b = counts.select("frame", F.col(by).alias(f"{by}_i"), F.col("atoms").alias("na")), counts.select("frame", F.col(by).alias(f"{by}_j"), F.col("atoms").alias("nb"))
    norms = a.join(b, "frame").groupBy(f"{by}_i", f"{by}_j").agg(F.sum(F.col("na") * F.col("nb") / volume).alias("ideal"), F.sum("na").alias("centers"))
    low, high = F.col("bin") * width, (F.col("bin") + 1) * width
    size = shell(low, high) if edge == "shell" else 4 * math.pi * high * high * width
    running = F.sum("n").over(Window.partitionBy(f"{by}_i", f"{by}_j").orderBy("bin"))
    return histogram.join(norms, [f"{by}_i", f"{by}_j"]).select(
        f"{by}_i", f"{by}_j", "bin", ((F.col("bin") + 0.5) * width if edge == "shell" else high).alias("r"), "n",
        (F.col("n") / (F.col("ideal") * size)).alias("g"), (running / F.col("centers")).alias("cn"),
    )


def total_rdf(partial: DataFrame, fractions: DataFrame, density: float, lengths: dict | None = None, by: str = "type") -> DataFrame:
    """(bin, r, g, t): sum of partial curves over ordered pairs, weighted by concentrations and, with scattering
    lengths, by b_a b_b / <b>^2; t = 4 pi r rho g. Ordered pairs count cross terms twice."""
    weight = {k: float(v) for k, v in (lengths or {}).items()}
    known = F.create_map(*(x for k, v in weight.items() for x in (F.lit(k), F.lit(v)))) if weight else None
    of = fractions.select(by, "fraction", (F.try_element_at(known, F.col(by)) if known is not None else F.lit(1.0)).alias("b"))
    mean = of.agg(F.sum(F.col("fraction") * F.col("b")).alias("mean"))
    side = lambda s: of.select(F.col(by).alias(f"{by}_{s}"), F.col("fraction").alias(f"c{s}"), F.col("b").alias(f"b{s}"))
    term = F.col("ci") * F.col("cj") * F.col("bi") * F.col("bj") / (F.col("mean") * F.col("mean")) * F.col("g")
    out = partial.join(side("i"), f"{by}_i").join(side("j"), f"{by}_j").crossJoin(mean).groupBy("bin", "r").agg(F.sum(term).alias("g"))
    return out.withColumn("t", 4 * math.pi * density * F.col("r") * F.col("g"))


def grid(df: DataFrame, name: str, step: float, count: int, start: float = 0.0) -> DataFrame:
    """Each row beside every point of a grid."""
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn(name, start + F.col("_k") * step).drop("_k")


def sine_transform(partial: DataFrame, fractions: DataFrame, density: float, width: float, q_step: float, q_count: int, by: str = "type") -> DataFrame:
    """(<by>_i, <by>_j, q, s): 4 pi rho sqrt(c_a c_b) sum r^2 (g - 1) sin(qr)/(qr) dr + delta_ab."""
    c = {s: fractions.select(F.col(by).alias(f"{by}_{s}"), F.col("fraction").alias(f"c{s}")) for s in "ij"}
    points = grid(partial.join(c["i"], f"{by}_i").join(c["j"], f"{by}_j"), "q", q_step, q_count)
    qr = F.col("q") * F.col("r")
    term = F.col("r") * F.col("r") * (F.col("g") - 1) * F.sin(qr) / qr * width
    out = points.groupBy(f"{by}_i", f"{by}_j", "q", "ci", "cj").agg(F.sum(term).alias("sum"))
    return out.select(f"{by}_i", f"{by}_j", "q", (4 * math.pi * density * F.sqrt(F.col("ci") * F.col("cj")) * F.col("sum") + (F.col(f"{by}_i") == F.col(f"{by}_j")).cast("double")).alias("s"))


def form_factor(q: Column, a: Sequence[float], b: Sequence[float], c: float) -> Column:
    """c + sum a exp(-b (q / 4 pi)^2)."""
    k = q / (4 * math.pi)
    return sum((x * F.exp(-y * k * k) for x, y in zip(a, b, strict=True)), F.lit(float(c)))


def weighted_sq(partial: DataFrame, fractions: DataFrame, factor: dict, by: str = "type") -> DataFrame:
    """(q, s): partial structure factors weighted by sqrt(c_a c_b) f_a f_b / (sum c f)^2. factor: kind -> f(q) -> Column, or a number."""
    pick = lambda kind: F.coalesce(*(F.when(kind == F.lit(k), f(F.col("q")) if callable(f) else F.lit(float(f))) for k, f in factor.items()))
    side = lambda end: fractions.select(F.col(by).alias(f"{by}_{end}"), F.col("fraction").alias(f"_c{end}"))
    i, j = F.col(f"{by}_i"), F.col(f"{by}_j")
    met = partial.join(side("i"), f"{by}_i").join(side("j"), f"{by}_j")
    sums = met.groupBy("q").agg(F.sum(F.sqrt(F.col("_ci") * F.col("_cj")) * pick(i) * pick(j) * F.col("s")).alias("sum"))
    mean = sums.select("q").crossJoin(fractions.select(F.col(by).alias("_kind"), "fraction")).groupBy("q").agg(F.sum(F.col("fraction") * pick(F.col("_kind"))).alias("_mean"))  # a row for each kind
    return sums.join(mean, "q").select("q", (F.col("sum") / (F.col("_mean") * F.col("_mean"))).alias("s"))


@dataclass(frozen=True)
class Triplet:
    """An angle wing_a - center - wing_c with the distance window of each arm."""

    label: str
    center: object
    wing_a: object
    wing_c: object
    r_a: tuple[float, float]
    r_c: tuple[float, float]

    @property
    def same_arm(self) -> bool:
        return self.wing_a == self.wing_c and self.r_a == self.r_c


def default_triplets(kinds: Sequence, cutoffs: dict[tuple, float]) -> list[Triplet]:
    """Every center with every unordered pair of wings, within the pairs' cutoffs; a label that comes twice gets a number."""
    out: list[Triplet] = []
    for center in kinds:
        for k, a in enumerate(kinds):
            for c in kinds[k:]:
                ra, rc = (cutoffs.get(tuple(sorted((center, w)))) for w in (a, c))
                if ra and rc:
                    out.append(Triplet(f"{a}-{center}-{c}", center, a, c, (0.0, ra), (0.0, rc)))
    return unique_labels(out)


def unique_labels(plans: Sequence[Triplet]) -> list[Triplet]:
    """The same triplets with distinct labels; the same triplet twice is an error."""
    seen: dict[str, int] = {}
    out = []
    if len(set(plans)) < len(plans):
        raise ValueError("a triplet is listed twice")
    for p in plans:
        seen[p.label] = seen.get(p.label, 0) + 1
        out.append(p if seen[p.label] == 1 else Triplet(f"{p.label}_{seen[p.label]}", p.center, p.wing_a, p.wing_c, p.r_a, p.r_c))
    return out


def angles(near: DataFrame, plans: Sequence[Triplet], by: str = "type", keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, i, j, k, label, theta): angles at i between the arms to j and k, in degrees.

    All plans share one pair list, which must reach their largest distance. Arms of one kind and window give unordered
    pairs; arms of one kind and different windows never take the same atom twice.
    """
    def arms(side: str) -> DataFrame:
        window = lambda p: p.r_a if side == "a" else p.r_c
        kind = lambda p: p.wing_a if side == "a" else p.wing_c
        fit = lambda p: (F.col(f"{by}_i") == F.lit(p.center)) & (F.col(f"{by}_j") == F.lit(kind(p))) & F.col("r").between(*window(p))
        labels = F.filter(F.array(*(F.when(fit(p), F.struct(F.lit(p.label).alias("label"), F.lit(p.same_arm).alias("same"))) for p in plans)), lambda x: x.isNotNull())
        rows = near.select(*keys, "i", F.col("j").alias(f"j{side}"), *(F.col(f"d{x}").alias(f"{x}{side}") for x in "xyz"), F.col("r").alias(f"r{side}"), F.explode(labels).alias("plan"))
        return rows.select("*", "plan.label", F.col("plan.same").alias(f"same{side}")).drop("plan")

    both = arms("a").join(arms("c"), [*keys, "i", "label"]).filter(F.when(F.col("samea"), F.col("ja") < F.col("jc")).otherwise(F.col("ja") != F.col("jc")))
    cosine = dot([F.col(f"{x}a") for x in "xyz"], [F.col(f"{x}c") for x in "xyz"]) / (F.col("ra") * F.col("rc"))
    return both.select(*keys, "i", F.col("ja").alias("j"), F.col("jc").alias("k"), "label", F.degrees(clamped_acos(cosine)).alias("theta"))


def angle_bins(atoms: DataFrame, plans: Sequence[Triplet], width: float, box: Box, by: str = "type", keys: Sequence[str] = ("frame",), **options) -> DataFrame:
    """(keys, label, bin, n): angles() counted in bins over [0, 180], the last one closed.

    All pairs of a center lie in its block, so arms meet there, and only counts leave it.
    """
    reach = max(r for p in plans for r in (p.r_a[1], p.r_c[1]))
    blocks = Blocks(atoms, reach, box, keys=keys, carry=(by,), **options)
    count, search = round(180 / width), blocks.search
    shape = StructType([*(blocks.fields()[k] for k in keys), StructField("label", StringType()), StructField("bin", IntegerType()), StructField("n", LongType())])

    def counted(block: pa.Table) -> pa.Table:
        i, j, d, r = search.near(block)
        order = np.lexsort((j, i))
        i, j, d, r = i[order], j[order], d[order], r[order]
        kind, ids = block.column(by).to_pylist(), block.column("atom_id").to_numpy()
        code = {k: np.array([x == k for x in kind], bool) for k in {k for p in plans for k in (p.center, p.wing_a, p.wing_c)}}
        labels, bins, counts = [], [], []
        for p in plans:
            fit = [np.flatnonzero(code[p.center][i] & code[w][j] & (r >= low) & (r <= high)) for w, (low, high) in ((p.wing_a, p.r_a), (p.wing_c, p.r_c))]
            first = np.searchsorted(i[fit[1]], i[fit[0]])
            size = np.searchsorted(i[fit[1]], i[fit[0]], "right") - first
            total = np.zeros(count, np.int64)
            edges = np.flatnonzero(np.diff(np.cumsum(size) // TOGETHER)) + 1
            for part in np.split(np.arange(len(size)), edges):
                which, place = spans(first[part], size[part])
                a, c = fit[0][part][which], fit[1][place]
                keep = ids[j[a]] < ids[j[c]] if p.same_arm else ids[j[a]] != ids[j[c]]
                a, c = a[keep], c[keep]
                cosine = (d[a, 0] * d[c, 0] + d[a, 1] * d[c, 1] + d[a, 2] * d[c, 2]) / (r[a] * r[c])
                theta = np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0)))
                total += np.bincount(np.minimum(np.floor(theta / width).astype(np.int64), count - 1), minlength=count)
            at = np.flatnonzero(total)
            labels += [p.label] * len(at)
            bins.append(at)
            counts.append(total[at])
        at = np.concatenate(bins)
        return pa.table({k: block.column(k).combine_chunks().take(pa.array(np.zeros(len(at), np.int64))) for k in keys} | {"label": pa.array(labels, pa.string()), "bin": at.astype(np.int32), "n": np.concatenate(counts)})

    return blocks.apply(counted, shape, (by,)).groupBy(*keys, "label", "bin").agg(F.sum("n").alias("n"))


def angle_distribution(found: DataFrame, width: float = 1.0, keys: Sequence[str] = ("frame",), norm: str = "frame") -> DataFrame:
    """(label, bin, n, p): histogram over [0, 180] of angles (keys, label, theta), the last bin closed."""
    count = round(180 / width)
    return binned_angles(found.groupBy("label", *keys, closed_bin(F.col("theta"), 0.0, width, count).alias("bin")).agg(F.count("*").alias("n")), width, keys, norm)


def binned_angles(bins: DataFrame, width: float = 1.0, keys: Sequence[str] = ("frame",), norm: str = "frame") -> DataFrame:
    """(label, bin, n, p) of counts (keys, label, bin, n).

    norm="frame" gives each contributing frame unit area and averages the frames; "sum" gives all counts unit sum.
    """
    if norm == "sum":
        total = bins.groupBy("label").agg(F.sum("n").alias("total"))
        return bins.groupBy("label", "bin").agg(F.sum("n").alias("n")).join(total, "label").select("label", "bin", "n", (F.col("n") / F.col("total")).alias("p"))
    area = bins.groupBy("label", *keys).agg(F.sum("n").alias("area"))
    frames = area.groupBy("label").agg(F.count("*").alias("frames"))
    each = bins.join(area, ["label", *keys]).groupBy("label", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") / (F.col("area") * width)).alias("sum"))
    return each.join(frames, "label").select("label", "bin", "n", (F.col("sum") / F.col("frames")).alias("p"))


def debye_sq(histogram: DataFrame, counts: DataFrame, width: float, q_step: float, q_count: int, by: str = "type") -> DataFrame:
    """(<by>_i, <by>_j, q, s): delta_ab + sum n sin(qr)/(qr) / sqrt(N_a N_b), by the distances' histogram."""
    total = counts.groupBy(by).agg(F.sum("atoms").alias("atoms"))
    side = lambda s: total.select(F.col(by).alias(f"{by}_{s}"), F.col("atoms").alias(f"n{s}"))
    points = grid(histogram.join(side("i"), f"{by}_i").join(side("j"), f"{by}_j"), "q", q_step, q_count)
    qr = F.col("q") * (F.col("bin") + 0.5) * width
    out = points.groupBy(f"{by}_i", f"{by}_j", "q", "ni", "nj").agg(F.sum(F.col("n") * F.sin(qr) / qr).alias("sum"))
    return out.select(f"{by}_i", f"{by}_j", "q", ((F.col(f"{by}_i") == F.col(f"{by}_j")).cast("double") + F.col("sum") / F.sqrt(F.col("ni") * F.col("nj"))).alias("s"))


def half_points(shells: int) -> np.ndarray:
    """Whole-numbered points (h, k, l) up to a length, one of each pair q, -q."""
    m = np.arange(-shells, shells + 1)
    h, k, l = (x.ravel() for x in np.meshgrid(np.arange(shells + 1), m, m, indexing="ij"))  # noqa: E741
    length = h * h + k * k + l * l
    return np.stack([h, k, l], 1)[(length > 0) & (length <= shells * shells) & ((h > 0) | (k > 0) | (k == 0) & (l > 0))]


def density_waves(atoms: DataFrame, box: float, points: Callable[[], np.ndarray], keys: Sequence[str]) -> DataFrame:
    """(keys, h, k, l, c, s, n): sums of cos and sin of q r over each group's atoms, at points of a cubic cell's reciprocal
    lattice, which every task makes for itself.

    A batch of atoms gives one partial sum for each of its groups and points, so no atom is ever beside all points.
    """
    types = dict(atoms.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hkl = points()
        for batch in batches:
            batch = batch.sort_values(list(keys))
            new = (batch[list(keys)] != batch[list(keys)].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            count = np.diff(np.append(starts, len(batch)))
            place = batch[["x", "y", "z"]].to_numpy(float)
            some = max(1, (1 << 20) // max(len(batch), 1))
            for k in range(0, len(hkl), some):
                part = hkl[k : k + some]
                phase = place @ part.T * (2 * math.pi / box)
                c, s = (np.add.reduceat(f(phase), starts, axis=0) for f in (np.cos, np.sin))
                out = batch.iloc[np.repeat(starts, len(part))][list(keys)].reset_index(drop=True)
                yield out.assign(**{n: np.tile(part[:, j], len(starts)) for j, n in enumerate("hkl")}, c=c.ravel(), s=s.ravel(), n=np.repeat(count, len(part)))

    rows = atoms.select(*keys, "x", "y", "z").filter("x is not null and y is not null and z is not null")
    found = rows.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "h int, k int, l int, c double, s double, n long"]))
    return found.groupBy(*keys, "h", "k", "l").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("n").alias("n"))


def reciprocal_sq(atoms: DataFrame, box: float, shells: int, by: str = "type") -> DataFrame:
    """(<by>_i, <by>_j, q2, s): structure factors at the cell's reciprocal points up to `shells` times 2 pi / L.

    q2 is the squared length in units of 2 pi / L.
    """
    waves = density_waves(atoms, box, lambda: half_points(shells), ["frame", by]).withColumn("q2", F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l"))
    other = waves.select("frame", "h", "k", "l", F.col(by).alias(f"{by}_j"), F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    both = waves.withColumnRenamed(by, f"{by}_i").join(other, ["frame", "h", "k", "l"]).filter(F.col(f"{by}_i") <= F.col(f"{by}_j"))
    return both.groupBy(f"{by}_i", f"{by}_j", "q2").agg(F.avg((F.col("c") * F.col("c2") + F.col("s") * F.col("s2")) / F.sqrt(F.col("n") * F.col("n2"))).alias("s"))


CELL = ("lx", "ly", "lz", "xy", "xz", "yz")


def fractional(atoms: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Atoms with coordinates as shares of their own frame's cell vectors, by columns for its edges and tilts."""
    lx, ly, lz, xy, xz, yz = (F.col(c) for c in cell)
    sz = F.col("z") / lz
    sy = (F.col("y") - sz * yz) / ly
    return atoms.withColumns({"x": (F.col("x") - sy * xy - sz * xz) / lx, "y": sy, "z": sz})


#: Atoms of a frame that are summed up together, and terms (atom, reciprocal point) that one task of reciprocal_cells() sums.
WHOLE, TERMS = 1 << 17, 1 << 34


def cell_planes(cell: Sequence[float], q_max: float, part: int = 0, parts: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(h, k, first, m, q, inside): points (h, k, first + m) of a cell's reciprocal lattice with their lengths, by planes of h.

    Only indices that q_max leaves possible are looked at, however much the cell leans; inside tells which points lie up to
    q_max, of each pair q, -q one. Rows of k are dealt to the parts in turn.
    """
    lx, ly, lz, xy, xz, yz = cell
    unit = 2 * math.pi
    m = np.arange(-int(q_max * abs(lz) / unit) - 2, int(q_max * abs(lz) / unit) + 3)
    for h in range(int(q_max * abs(lx) / unit) + 2):
        qx = unit * h / lx
        ends = sorted((xy * qx + side * q_max * ly) / unit for side in (-1, 1))
        k = np.arange(math.floor(ends[0]) - 1, math.ceil(ends[1]) + 2)
        k = k[(k + h) % parts == part]
        qy = (unit * k - xy * qx) / ly
        k, qy = k[abs(qy) <= q_max], qy[abs(qy) <= q_max]
        first = np.rint((xz * qx + yz * qy) / unit).astype(np.int64)
        l = first[:, None] + m[None, :]  # noqa: E741
        qz = (unit * l - xz * qx - yz * qy[:, None]) / lz
        q = np.sqrt(qx * qx + (qy * qy)[:, None] + qz * qz)
        inside = (q <= q_max) & ((h > 0) | (k[:, None] > 0) | ((k[:, None] == 0) & (l > 0)))
        if inside.any():
            yield h, k, first, m, q, inside


def cell_waves(share: np.ndarray, h: int, k: np.ndarray, first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sums of exp(i q r) over atoms at shares of their cell's vectors, at the points (h, k, first + m)."""
    turn = lambda x: np.exp(2j * math.pi * (x - np.rint(x)))
    step = turn(share[:, 2, None] * m[None, :])
    out = np.empty((len(k), len(m)), complex)
    some = max(1, (1 << 17) // max(len(share), 1))
    for at in range(0, len(k), some):
        rows = slice(at, at + some)
        out[rows] = turn(h * share[None, :, 0] + k[rows, None] * share[None, :, 1] + first[rows, None] * share[None, :, 2]) @ step
    return out


def reciprocal_cells(atoms: DataFrame, q_max: float, q_step: float, by: str = "type", cell: Sequence[str] = CELL) -> DataFrame:
    """(<by>_i, <by>_j, bin, n, s): structure factors at the reciprocal points of each frame's own cell, averaged over the
    frames' points in bins of |q| up to q_max.

    atoms carry their frame's cell: edges lx, ly, lz and tilts xy, xz, yz. Each frame has only the points of its own cell up
    to q_max, plane by plane; a cell without volume has no reciprocal points and gives none. A frame whose points are many
    is dealt to several tasks by its points. A task that has all atoms of a frame gives one row for each bin, so points are
    never rows; only those of frames of more than WHOLE atoms are, whose sums over parts of the atoms must meet first.
    """
    types = dict(atoms.dtypes)
    rows = atoms.filter("x is not null and y is not null and z is not null").filter(F.col(cell[0]) * F.col(cell[1]) * F.col(cell[2]) != 0)
    rows = rows.select("frame", F.col(by), "x", "y", "z", F.array(*(F.col(c).cast("double") for c in cell)).alias("_cell"))
    volume = F.abs(F.get("_cell", F.lit(0)) * F.get("_cell", F.lit(1)) * F.get("_cell", F.lit(2)))
    sizes = rows.groupBy("frame").agg(F.count("*").alias("_n"), F.max(volume * q_max**3 / (12 * math.pi**2)).alias("_points"))
    chunks = F.ceil(F.col("_n") / WHOLE)
    parts = F.greatest(F.ceil(F.col("_points") * F.col("_n") / chunks / TERMS), F.lit(1)).cast("int")
    dealt = rows.join(sizes.select("frame", chunks.alias("_chunks"), parts.alias("_parts")), "frame")
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("x", "y", "z"), F.col("_chunks"))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def planes(block: pa.Table) -> Iterator[tuple]:
        """(points, their lengths, sums of each kind) by planes; the kinds' numbers of atoms are those of shares()."""
        shape, (part, count) = block.column("_cell")[0].as_py(), (block.column(c)[0].as_py() for c in ("_part", "_parts"))
        sums = shares(block)
        for h, k, first, m, q, inside in cell_planes(shape, q_max, part, count):
            a, b = np.nonzero(inside)
            yield np.stack([np.full(len(a), h), k[a], first[a] + m[b]], 1), q[a, b], [cell_waves(s, h, k, first, m)[a, b] for s in sums]

    def kinds(block: pa.Table) -> tuple[pa.Array, np.ndarray]:
        told = block.column(by).combine_chunks().dictionary_encode()
        return told.dictionary, told.indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def shares(block: pa.Table) -> list[np.ndarray]:
        """Each kind's places as shares of the cell's vectors."""
        (names, which), (lx, ly, lz, xy, xz, yz) = kinds(block), block.column("_cell")[0].as_py()
        x, y, z = (block.column(c).to_numpy().astype(float) for c in "xyz")
        sz = z / lz
        sy = (y - sz * yz) / ly
        share = np.stack([(x - sy * xy - sz * xz) / lx, sy, sz], 1)
        return [share[which == k] for k in range(len(names))]

    def summed(block: pa.Table) -> pa.Table:
        """Numbers of points and sums over them, by kinds and bins."""
        (names, _), n = kinds(block), [len(s) for s in shares(block)]
        pairs_ = [(i, j) for i in range(len(n)) for j in range(i, len(n))]
        count, total = np.zeros((len(pairs_), 0), np.int64), np.zeros((len(pairs_), 0))
        for _, q, waves in planes(block):
            at = np.floor(q / q_step).astype(np.int64)
            wide = max(int(at.max()) + 1 - count.shape[1], 0)
            count, total = (np.pad(x, ((0, 0), (0, wide))) for x in (count, total))
            for p, (i, j) in enumerate(pairs_):
                count[p] += np.bincount(at, minlength=count.shape[1])
                total[p] += np.bincount(at, (waves[i] * waves[j].conj()).real / math.sqrt(n[i] * n[j]), count.shape[1])
        p, at = np.nonzero(count)
        i, j = (pa.array([pairs_[x][k] for x in p], pa.int64()) for k in range(2))
        return pa.table({"_a": names.take(i), "_b": names.take(j), "bin": pa.array(at, pa.int32()), "n": count[p, at], "_sum": total[p, at]})

    def waved(block: pa.Table) -> pa.Table:
        """Sums of a part of a frame's atoms, at each point."""
        (names, _), n, frame = kinds(block), [len(s) for s in shares(block)], block.column("frame").slice(0, 1)
        found = []
        for points, q, waves in planes(block):
            for k, w in enumerate(waves):
                told = {"frame": frame.take(pa.array(np.zeros(len(q), np.int64))), by: names.take(pa.array(np.full(len(q), k)))}
                found.append(pa.table(told | {c: points[:, x] for x, c in enumerate("hkl")} | {"q": q, "c": w.real, "s": w.imag, "n": np.full(len(q), n[k])}))
        return pa.concat_tables(found) if found else pa.table({"frame": frame.slice(0, 0), by: names.slice(0, 0), **{c: pa.array([], pa.int64()) for c in "hkl"}, **{c: pa.array([], pa.float64()) for c in "qcs"}, "n": pa.array([], pa.int64())})

    near = dealt.filter("_chunks = 1").groupBy("frame", "_part").applyInArrow(summed, f"_a {types[by]}, _b {types[by]}, bin int, n long, _sum double")
    near = near.select(F.least("_a", "_b").alias(f"{by}_i"), F.greatest("_a", "_b").alias(f"{by}_j"), "bin", "n", "_sum").filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    waves = dealt.filter("_chunks > 1").groupBy("frame", "_chunk", "_part").applyInArrow(waved, f"frame {types['frame']}, `{by}` {types[by]}, h long, k long, l long, q double, c double, s double, n long")
    waves = waves.groupBy("frame", by, "h", "k", "l").agg(F.max("q").alias("q"), *(F.sum(c).alias(c) for c in "csn")).withColumn("bin", F.floor(F.col("q") / q_step).cast("int"))
    other = waves.select("frame", "h", "k", "l", F.col(by).alias(f"{by}_j"), F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    both = waves.withColumnRenamed(by, f"{by}_i").join(other, ["frame", "h", "k", "l"]).filter(F.col(f"{by}_i") <= F.col(f"{by}_j"))
    far = both.select(f"{by}_i", f"{by}_j", "bin", F.lit(1).cast("bigint").alias("n"), ((F.col("c") * F.col("c2") + F.col("s") * F.col("s2")) / F.sqrt(F.col("n") * F.col("n2"))).alias("_sum"))
    return near.unionByName(far).groupBy(f"{by}_i", f"{by}_j", "bin").agg(F.sum("n").alias("n"), (F.sum("_sum") / F.sum("n")).alias("s"))


def faber_ziman(partial: DataFrame, fractions: DataFrame, by: str = "type") -> DataFrame:
    """(<by>_i, <by>_j, q, a): Faber-Ziman partials 1 + (S - delta) / sqrt(c_a c_b) of partials (<by>_i, <by>_j, q, s)."""
    side = lambda s: fractions.select(F.col(by).alias(f"{by}_{s}"), F.col("fraction").alias(f"c{s}"))
    delta = F.when(F.col(f"{by}_i") == F.col(f"{by}_j"), 1.0).otherwise(0.0)
    met = partial.join(side("i"), f"{by}_i").join(side("j"), f"{by}_j")
    return met.select(f"{by}_i", f"{by}_j", "q", (1 + (F.col("s") - delta) / F.sqrt(F.col("ci") * F.col("cj"))).alias("a"))


def neutron_total(partial: DataFrame, fractions: DataFrame, lengths: dict, by: str = "type") -> DataFrame:
    """(q, s): sum over unordered pairs of (2 - delta) c_a c_b b_a b_b A_ab, by the square of the mean length."""
    known = F.create_map(*(F.lit(x) for kv in lengths.items() for x in kv))
    of = fractions.select(by, (F.col("fraction") * F.element_at(known, F.col(by))).alias("w"))
    mean = of.agg(F.sum("w").alias("mean"))
    side = lambda s: of.select(F.col(by).alias(f"{by}_{s}"), F.col("w").alias(f"w{s}"))
    twice = F.when(F.col(f"{by}_i") == F.col(f"{by}_j"), 1.0).otherwise(2.0)
    met = partial.filter(F.col(f"{by}_i") <= F.col(f"{by}_j")).join(side("i"), f"{by}_i").join(side("j"), f"{by}_j").crossJoin(mean)
    return met.groupBy("q").agg(F.sum(twice * F.col("wi") * F.col("wj") * F.col("a") / (F.col("mean") * F.col("mean"))).alias("s"))


def arm_angles(near: DataFrame, first: dict[tuple, tuple], second: dict[tuple, tuple], width: float, by: str = "type", keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(a, center, c, bin, n, p): angles whose arms fit one table each, of unit sum for every triple of kinds.

    first, second: (center, wing) -> (r_min, r_max). A pair of arms counts if one fits the first table and the other the
    second, half for each order of its wings. 180 degrees belong to the last bin.
    """
    count = round(180 / width)

    def fits(table: dict[tuple, tuple]) -> Column:
        cases = [(F.col(f"{by}_i") == i) & (F.col(f"{by}_j") == j) & F.col("r").between(low, high) for (i, j), (low, high) in table.items()]
        return reduce(lambda x, y: x | y, cases, F.lit(False))

    arms = near.withColumns({"_first": fits(first), "_second": fits(second)}).filter(F.col("_first") | F.col("_second"))
    names = ["j", f"{by}_j", "dx", "dy", "dz", "r", "_first", "_second"]
    other = arms.select(*keys, "i", *(F.col(c).alias(f"{c}2") for c in names))
    met = arms.join(other, [*keys, "i"]).filter((F.col("j") < F.col("j2")) & ((F.col("_first") & F.col("_second2")) | (F.col("_second") & F.col("_first2"))))
    cosine = dot([F.col(f"d{a}") for a in "xyz"], [F.col(f"d{a}2") for a in "xyz"]) / (F.col("r") * F.col("r2"))
    orders = F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(c).alias("c")) for a, c in ((f"{by}_j", f"{by}_j2"), (f"{by}_j2", f"{by}_j")))))
    rows = met.select(F.col(f"{by}_i").alias("center"), closed_bin(F.degrees(clamped_acos(cosine)), 0.0, width, count).alias("bin"), orders.alias("o"))
    counts = rows.groupBy("o.a", "center", "o.c", "bin").agg((F.count("*") / 2).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a", "center", "c")))


def last_frames(rows: DataFrame, count: int, frame: str = "frame") -> DataFrame:
    """Rows of the last `count` frames and the one before, as an interval of frames is closed."""
    last = rows.agg(F.max(frame).alias("_last"))
    return rows.crossJoin(last).filter(F.col(frame) >= F.col("_last") - count).drop("_last")


def without_first(rows: DataFrame, file: str, frame: str = "frame") -> DataFrame:
    """Rows without the first frame of each file, where a run repeats the last frame of the one before."""
    first = rows.groupBy(file).agg(F.min(frame).alias("_first"))
    return rows.join(first, file).filter(F.col(frame) > F.col("_first")).drop("_first")


def unit_sum(curves: DataFrame, y: str, keys: Sequence[str]) -> DataFrame:
    """Curves divided by their own sum."""
    return curves.withColumn(y, F.try_divide(F.col(y), F.sum(y).over(Window.partitionBy(*keys))))
