"""Time-lagged correlations over several origins, and the spectra made from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, dot, minimum_image
from .distributions import density_waves
from .neighbors import EDGE, Blocks, candidate_cells


def lag_join(rows: DataFrame, columns: Sequence[str], length: int, step: int, frames: int, keys: Sequence[str] = ("atom_id",), origin_rule: str = "inclusive") -> DataFrame:
    """Each row beside the rows of its origins: (keys, ref, lag, <columns>, <columns>_0).

    Origins are frames 0, step, 2 step, ... up to frames - length (before it with origin_rule="strict"); lags are
    0 ... length - 1. Every row lists the origins it belongs to, so the range condition becomes an equi-join.
    """
    last = frames - length - (origin_rule == "strict")
    low, high = F.greatest(F.col("frame") - (length - 1), F.lit(0)), F.least(F.col("frame"), F.lit(last))
    first = F.ceil(low / step).cast("int")
    final = F.floor(high / step).cast("int")
    now = rows.filter(first <= final).select(*keys, "frame", *columns, F.explode(F.sequence(first, final)).alias("o"))
    now = now.select(*keys, (F.col("o") * step).cast("int").alias("ref"), (F.col("frame") - F.col("o") * step).cast("int").alias("lag"), *columns)
    then = rows.filter((F.col("frame") % step == 0) & (F.col("frame") <= last)).select(*keys, F.col("frame").cast("int").alias("ref"), *(F.col(c).alias(f"{c}_0") for c in columns))
    return now.join(then, [*keys, "ref"])


def msd(rows: DataFrame, box: Sequence[float | str], length: int, step: int, frames: int, by: str = "type", origin_rule: str = "inclusive") -> DataFrame:
    """(<by>, lag, n, msd): mean squared minimum-image displacement over atoms and origins.

    An edge of the box may be the name of a column: then that of the current frame, not the origin's, is taken.
    """
    named = [b for b in box if isinstance(b, str)]
    joined = lag_join(rows, [by, "x", "y", "z", *dict.fromkeys(named)], length, step, frames, origin_rule=origin_rule)
    d = [minimum_image(F.col(a) - F.col(f"{a}_0"), F.col(size) if isinstance(size, str) else size) for a, size in zip("xyz", box, strict=True)]
    return joined.groupBy(by, "lag").agg(F.count("*").alias("n"), F.avg(dot(d, d)).alias("msd"))


def weighted_total(curves: DataFrame, counts: DataFrame, x: str, y: str, by: str = "type") -> DataFrame:
    """Mean curve over kinds, weighted by their number of atoms. counts: (<by>, atoms)."""
    return curves.join(counts, by).groupBy(x).agg((F.sum(F.col(y) * F.col("atoms")) / F.sum("atoms")).alias(y))


def diffusion(curves: DataFrame, dt: float, fit_fraction: float = 0.5, by: str = "type") -> DataFrame:
    """(<by>, d): slope over the last part of the curve, by 6, in 1e-5 cm^2/s for lengths in angstrom and times in fs."""
    size = curves.groupBy(by).agg(F.count("*").alias("size"))
    tail = curves.join(size, by).filter(F.col("lag") >= F.floor(F.col("size") * (1 - fit_fraction)))
    return tail.groupBy(by).agg((F.regr_slope("msd", F.col("lag") * dt) / 6 * 1e4).alias("d"))


def vacf(rows: DataFrame, length: int, step: int, frames: int, by: str = "type") -> DataFrame:
    """(<by>, lag, c): velocity autocorrelation over atoms and origins, 1 at lag 0."""
    joined = lag_join(rows, [by, "vx", "vy", "vz"], length, step, frames)
    now, then = [F.col(f"v{a}") for a in "xyz"], [F.col(f"v{a}_0") for a in "xyz"]
    return joined.groupBy(by, "lag").agg((F.sum(dot(now, then)) / F.sum(dot(then, then))).alias("c"))


def cosine_spectrum(curves: DataFrame, length: int, dt: float, step: float, count: int, keys: Sequence[str] = ("type",), x: str = "lag", y: str = "c") -> DataFrame:
    """(keys, k, nu, g): sum C(t) cos(pi t / 2L) cos(2 pi nu t) dt at nu = k step; the taper ends at the last lag."""
    points = curves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("nu", F.col("k") * step)
    taper = F.cos(math.pi * F.col(x) / (2 * length))
    return points.groupBy(*keys, "k", "nu").agg(F.sum(F.col(y) * taper * F.cos(2 * math.pi * F.col("nu") * F.col(x) * dt) * dt).alias("g"))


def unit_area(curves: DataFrame, y: str, width: float, keys: Sequence[str] = ("type",)) -> DataFrame:
    """Curves scaled so that their sum times the grid's width is 1."""
    area = curves.groupBy(*keys).agg((F.sum(y) * width).alias("_area"))
    return curves.join(area, list(keys)).withColumn(y, F.try_divide(F.col(y), F.col("_area"))).drop("_area")


def phonon_weights(curves: DataFrame, counts: DataFrame, y: str = "g", by: str = "type") -> DataFrame:
    """Spectra times 6 / pi times the kind's share of atoms. counts: (<by>, atoms)."""
    total = counts.agg(F.sum("atoms").alias("_all"))
    return curves.join(counts, by).crossJoin(total).withColumn(y, F.col(y) * 6 / math.pi * F.col("atoms") / F.col("_all")).drop("atoms", "_all")


def current_correlation(rows: DataFrame, charge: Column, length: int, step: int, frames: int) -> DataFrame:
    """(lag, c): autocorrelation of the frames' charge current, the sum of q v, 1 at lag 0."""
    current = rows.groupBy("frame").agg(*(F.sum(charge * F.col(f"v{a}")).alias(f"j{a}") for a in "xyz")).withColumn("system", F.lit(0))
    joined = lag_join(current, ["jx", "jy", "jz"], length, step, frames, keys=("system",))
    now, then = [F.col(f"j{a}") for a in "xyz"], [F.col(f"j{a}_0") for a in "xyz"]
    return joined.groupBy("lag").agg((F.sum(dot(now, then)) / F.sum(dot(then, then))).alias("c"))


def rotational(axes: DataFrame, length: int, step: int, frames: int, keys: Sequence[str] = ("atom_id",)) -> DataFrame:
    """(axis, lag, c1, c2) from unit vectors (frame, keys, axis, ux, uy, uz): means of cos and of its second Legendre
    polynomial over the molecules that are present at both times."""
    joined = lag_join(axes, ["ux", "uy", "uz"], length, step, frames, keys=[*keys, "axis"])
    cosine = dot([F.col(f"u{a}") for a in "xyz"], [F.col(f"u{a}_0") for a in "xyz"])
    return joined.groupBy("axis", "lag").agg(F.avg(cosine).alias("c1"), F.avg((3 * cosine * cosine - 1) / 2).alias("c2"))


def molecule_axes(bonds: DataFrame) -> DataFrame:
    """(frame, atom_id, axis, ux, uy, uz) from bonds (frame, i, j, dx, dy, dz) of a center to its hydrogens, by id.

    Three or more: e1 the sum of all, e2 the first, e3 the difference of the second and the first. Two: e1 the first,
    e2 and e3 the difference. Fewer make no molecule.
    """
    listed = bonds.groupBy("frame", F.col("i").alias("atom_id")).agg(F.array_sort(F.collect_list(F.struct("j", "dx", "dy", "dz"))).alias("b")).filter(F.size("b") >= 2)
    at = lambda k, a: F.element_at("b", k)[f"d{a}"]
    total = lambda a: F.aggregate("b", F.lit(0.0), lambda s, x: s + x[f"d{a}"])
    many = F.size("b") > 2
    axes = {
        "e1": [F.when(many, total(a)).otherwise(at(1, a)) for a in "xyz"],
        "e2": [F.when(many, at(1, a)).otherwise(at(2, a) - at(1, a)) for a in "xyz"],
        "e3": [at(2, a) - at(1, a) for a in "xyz"],
    }
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), *(v.alias(f"w{a}") for a, v in zip("xyz", parts, strict=True))) for n, parts in axes.items())))
    rows = listed.select("frame", "atom_id", each.alias("e")).select("frame", "atom_id", "e.*")
    size = F.sqrt(F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy") + F.col("wz") * F.col("wz"))
    return rows.filter(size > 0).select("frame", "atom_id", "axis", *((F.col(f"w{a}") / size).alias(f"u{a}") for a in "xyz"))


def survival(present: DataFrame, length: int, step: int, frames: int, keys: Sequence[str] = ("i", "j")) -> DataFrame:
    """(lag, alive, s): share of an origin's pairs that are still there, and have been in every frame since.

    present: (frame, keys), one row for each pair and frame.
    """
    joined = lag_join(present.select("frame", *keys).distinct(), [], length, step, frames, keys=keys)
    run = F.row_number().over(Window.partitionBy(*keys, "ref").orderBy("lag")) - 1
    alive = joined.withColumn("run", run).filter(F.col("run") == F.col("lag")).groupBy("lag").agg(F.count("*").alias("alive"))
    start = alive.filter("lag = 0").select(F.col("alive").alias("start"))
    return alive.crossJoin(start).select("lag", "alive", (F.col("alive") / F.col("start")).alias("s"))


def lasting(
    cells: Iterator[tuple[np.ndarray, np.ndarray]], centers: Sequence[np.ndarray], wings: Sequence[np.ndarray], center_fits: Sequence[np.ndarray], wing_fits: Sequence[np.ndarray], r_max: float,
    exact: Callable[[int, np.ndarray, np.ndarray], np.ndarray], same: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, most: int = 1 << 18,
) -> np.ndarray:
    """Numbers of pairs of the cells (i, j) that have been within r_max at every lag up to each.

    Places are (atoms, 3) at each lag. Squared distances are products of short floats; pairs that these leave in doubt are
    told by exact(lag, i, j). An atom that doesn't fit at a lag has no pair there; same(i, j) tells an atom from itself.
    """
    alive = np.zeros(len(centers), np.int64)
    # -2 a b + a a + b b as one product; those that don't fit lie far off, on opposite sides
    a_side, b_side, doubt = [], [], 0.0
    for a, b, fa, fb in zip(centers, wings, center_fits, wing_fits, strict=True):
        a, b = np.where(fa[:, None], a, 1e6).astype(np.float32), np.where(fb[:, None], b, -1e6).astype(np.float32)
        aa, bb = (np.einsum("ij,ij->i", x, x)[:, None] for x in (a, b))
        a_side.append(np.concatenate([-2 * a, aa, np.ones_like(aa)], 1))
        b_side.append(np.concatenate([b, np.ones_like(bb), bb], 1))
        doubt = max(doubt, *(float(x[f].max(initial=0.0)) for x, f in ((aa[:, 0], fa), (bb[:, 0], fb))))
    doubt = 4e-6 * doubt + 1e-6 * r_max * r_max
    low, high = np.float32(r_max * r_max - doubt), np.float32(r_max * r_max + doubt)
    for i, every in cells:
        for at in range(0, len(every), max(most // len(i), 1)):
            j = every[at : at + max(most // len(i), 1)]
            held = None
            for k in range(len(centers)):
                squares = a_side[k][i] @ b_side[k][j].T
                held = squares <= high if held is None else held & (squares <= high)
                if k == 0 and same is not None:
                    held &= ~same(i, j)
                x, y = np.nonzero(held & (squares > low))
                if len(x):
                    held[x, y] = exact(k, i[x], j[y])
                n = np.count_nonzero(held)
                if not n:
                    break
                alive[k] += n
                if k == 0:
                    some = held.any(0)
                    held, j = held[:, some], j[some]
    return alive


def pair_survival(atoms: DataFrame, r_max: float, box: Sequence[float], length: int, step: int, frames: int, center: Column, wing: Column) -> DataFrame:
    """survival() of the pairs (center, wing) that are within r_max in a periodic box, which are counted where they are found.

    atoms: (frame, atom_id, x, y, z), one row for each atom and frame. An atom's places at all lags of an origin travel
    together to the origin frame's blocks of space, and only counts leave a block, so pairs are never rows.
    """
    used = {"_c": F.coalesce(center, F.lit(False)), "_w": F.coalesce(wing, F.lit(False))}
    there = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    rows = atoms.select("frame", "atom_id", *AXES, *(c.alias(n) for n, c in used.items())).filter(there & (F.col("_c") | F.col("_w")))
    low, last = F.greatest(F.col("frame") - (length - 1), F.lit(0)), frames - length
    first, final = F.ceil(low / step).cast("int"), F.floor(F.least(F.col("frame"), F.lit(last)) / step).cast("int")
    each = rows.filter(first <= final).repartition("atom_id").withColumn("ref", F.explode(F.transform(F.sequence(first, final), lambda o: o * step))).withColumn("_lag", F.col("frame") - F.col("ref"))
    names = [*AXES, *used]
    start_at = [F.max(F.when(F.col("_lag") == 0, F.col(n))).alias(n) for n in names]  # an atom that isn't there at the origin is in no block
    held = each.groupBy("ref", "atom_id").agg(F.collect_list(F.struct(F.col("_lag").cast("int").alias("_lag"), *names)).alias("_path"), *start_at)
    blocks = Blocks(held, r_max, box, keys=("ref",), center=F.col("_c"), wing=F.col("_w"), carry=("_path",), edge=EDGE * r_max)
    sizes = [float(b) for b in box]

    def counted(block: pa.Table) -> pa.Table:
        sides = [np.flatnonzero(block.column(c).to_numpy()) for c in ("_center", "_wing")]
        place = np.stack([block.column(f"_p{k}").to_numpy() for k in range(3)], 1)
        wrap = [block.column(f"_l{k}")[0].as_py() if block.column(f"_n{k}")[0].as_py() == 1 else None for k in range(3)]
        ids = block.column("atom_id").to_numpy()
        path = block.column("_path").combine_chunks()
        row, seen = path.value_parent_indices().to_numpy(), path.flatten()
        told = [seen.field(k).to_numpy(zero_copy_only=False) for k in range(len(names) + 1)]
        at, fit = np.full((length, 3, len(ids)), np.nan), np.zeros((2, length, len(ids)), bool)
        for c in range(3):
            at[told[0], c, row] = told[1 + c]
        for c in range(2):
            fit[c, told[0], row] = told[4 + c]
        alive = np.zeros(length, np.int64)
        moved = at - at[0]
        moved -= np.array(sizes)[None, :, None] * np.rint(moved / np.array(sizes)[None, :, None])
        far = max((float(np.nanmax(np.abs(moved[:, c]), initial=0.0)) + r_max) * 2 / sizes[c] for c in range(3))
        # where atoms move so little that a pair can only be near by the image by which it is at the origin, paths are followed
        # from there, and squared distances are matrix products
        if far < 1 and all(w is None for w in wrap):
            followed = place.T[None] + moved
            followed -= place.mean(0)[None, :, None]

            def exact(k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
                d = [at[k, c, sides[1][j]] - at[k, c, sides[0][i]] for c in range(3)]
                d = [x - size * np.rint(x / size) for x, size in zip(d, sizes, strict=True)]
                return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= r_max

            own = [[followed[k][:, side].T for k in range(length)] for side in sides]
            there = [[f[k, side] for k in range(length)] for f, side in zip(fit, sides, strict=True)]
            either = np.intersect1d(ids[sides[0]], ids[sides[1]]).size > 0
            same = (lambda i, j: ids[sides[0][i]][:, None] == ids[sides[1][j]][None, :]) if either else None
            cells = candidate_cells(place[sides[0]], place[sides[1]], r_max, wrap)
            return pa.table({"lag": np.arange(length, dtype=np.int32), "alive": lasting(cells, *own, *there, r_max, exact, same)})
        for i, j in candidate_cells(place[sides[0]], place[sides[1]], r_max, wrap):
            i, j = sides[0][i], sides[1][j]
            mine, theirs = at[:, :, i], at[:, :, j]
            good = [fit[0][:, i], fit[1][:, j]]
            a, b = None, None
            for k in range(length):
                if a is None:
                    d = [theirs[0, c][None, :] - mine[0, c][:, None] for c in range(3)]
                else:
                    d = [theirs[k, c][b] - mine[k, c][a] for c in range(3)]
                d = [x - size * np.rint(x / size) for x, size in zip(d, sizes, strict=True)]
                near = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= r_max
                if a is None:
                    a, b = np.nonzero(near & (ids[i][:, None] != ids[j][None, :]))
                else:
                    near = np.flatnonzero(near & good[0][k][a] & good[1][k][b])
                    a, b = a[near], b[near]
                alive[k] += len(a)
                if not len(a):
                    break
        return pa.table({"lag": np.arange(length, dtype=np.int32), "alive": alive})

    found = blocks.apply(counted, "lag int, alive long", ("_path",))
    alive = found.groupBy("lag").agg(F.sum("alive").alias("alive")).filter("alive > 0")
    start = alive.filter("lag = 0").select(F.col("alive").alias("start"))
    return alive.crossJoin(start).select("lag", "alive", (F.col("alive") / F.col("start")).alias("s"))


def welch_power(rows: DataFrame, length: int, step: int, by: str = "type") -> DataFrame:
    """(<by>, k, power): mean over segments of the windowed velocities' spectra, summed over axes and a kind's atoms.

    Atoms come sorted to their tasks, many in a batch; all their segments are transformed at once and summed by kind.
    An atom with fewer frames than a segment has no power.
    """
    hann = np.hanning(length)
    hann = hann / np.sqrt((hann**2).mean())

    def spectra(v: np.ndarray) -> np.ndarray:
        """Power of (atoms, frames, axes) at each frequency."""
        if v.shape[1] < length:
            return np.zeros((len(v), length // 2 + 1))
        parts = np.lib.stride_tricks.sliding_window_view(v, length, axis=1)[:, ::step] * hann
        return (np.abs(np.fft.rfft(parts, axis=3)) ** 2).sum(2).mean(1)

    def summed(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole atoms, by kind and number of frames."""
        size = part.groupby("atom_id", sort=False)["atom_id"].transform("size")
        for (kind, n), some in part.groupby([part[by], size], sort=False):
            total = spectra(some[["vx", "vy", "vz"]].to_numpy().reshape(-1, n, 3)).sum(0)
            yield pd.DataFrame({by: kind, "k": np.arange(len(total)), "power": total})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            whole = rest["atom_id"] != rest["atom_id"].iloc[-1]  # the last atom may go on
            if whole.any():
                yield from summed(rest[whole])
                rest = rest[~whole]
        if rest is not None and len(rest):
            yield from summed(rest)

    placed = rows.select("atom_id", "frame", by, "vx", "vy", "vz").repartition("atom_id").sortWithinPartitions("atom_id", "frame")
    found = placed.mapInPandas(run, f"{by} int, k int, power double")
    return found.groupBy(by, "k").agg(F.sum("power").alias("power"))


def dynamic_structure(rows: DataFrame, box: float, points: Sequence[tuple[int, int, int]], length: int, frames: int, dt: float, count: int, step: float) -> DataFrame:
    """(h, k, l, m, omega, s): coherent S(q, omega) at given reciprocal points of a cubic cell.

    Density waves are summed for each frame and point, correlated over all origins, and cosine-transformed; ÷ atoms.
    """
    waves = density_waves(rows, box, lambda: np.array(points), ["frame"])
    joined = lag_join(waves, ["c", "s", "n"], length, 1, frames, keys=("h", "k", "l"))
    f = joined.groupBy("h", "k", "l", "lag").agg(F.avg((F.col("c") * F.col("c_0") + F.col("s") * F.col("s_0")) / F.col("n")).alias("f"))
    return frequency_curve(f, ["h", "k", "l"], length, dt, count, step)


def frequency_curve(f: DataFrame, keys: Sequence[str], length: int, dt: float, count: int, step: float) -> DataFrame:
    """(keys, m, omega, s): even functions of time (keys, lag, f) tapered and cosine-transformed at omega = m step."""
    grid = f.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("omega", F.col("m") * step)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2.0) * F.cos(math.pi * F.col("lag") / (2 * length))
    return grid.groupBy(*keys, "m", "omega").agg(F.sum(weight * F.col("f") * F.cos(F.col("omega") * F.col("lag") * dt) * dt / (2 * math.pi)).alias("s"))


def self_structure(rows: DataFrame, box: float, points: Sequence[tuple[int, int, int]], length: int, step: int, frames: int, dt: float, count: int, omega: float, by: str = "type") -> DataFrame:
    """(<by>, h, k, l, m, omega, s): self part of S(q, omega), from the mean cosine of q times each atom's displacement.

    At points of the reciprocal lattice every periodic image gives the same cosine, so positions need no unwrapping.
    """
    moved = lag_join(rows, [by, "x", "y", "z"], length, step, frames).select(by, "lag", *((F.col(a) - F.col(f"{a}_0")).alias(a) for a in "xyz"))
    table = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, "hkl", strict=True))) for p in points)))
    at = moved.withColumn("_p", table).select(by, "lag", "x", "y", "z", "_p.*")
    phase = 2 * math.pi / box * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    f = at.groupBy(by, "h", "k", "l", "lag").agg(F.avg(F.cos(phase)).alias("f"))
    return frequency_curve(f, [by, "h", "k", "l"], length, dt, count, omega)


# Fixed values of units: energy (eV) of 1 THz, and THz of 1 / cm.
EV_PER_THZ, THZ_PER_CM = 0.0041356677, 0.0299792458


def frequency_units(energy: Column) -> dict[str, Column]:
    """An energy in eV also in meV, as a frequency in THz and as a wave number in 1 / cm."""
    thz = energy / EV_PER_THZ
    return {"ev": energy, "mev": energy * 1000, "thz": thz, "per_cm": thz / THZ_PER_CM}


def angular_to_thz(omega: Column) -> Column:
    """rad / fs as THz."""
    return omega * 1000 / (2 * math.pi)


def structure_table(coherent: DataFrame, own: DataFrame | None = None, keys: Sequence[str] = ("h", "k", "l", "m")) -> DataFrame:
    """(keys, omega, thz, s, <kind> ...): S(q, omega) as one long table, one row for each point and frequency; self parts
    (type, keys, s), if given, as a column for each kind."""
    out = coherent.withColumn("thz", angular_to_thz(F.col("omega")))
    if own is None:
        return out
    wide = own.groupBy(*keys).pivot("type").agg(F.first("s"))
    return out.join(wide.select(*keys, *(F.col(c).alias(f"self_{c}") for c in wide.columns if c not in keys)), list(keys))
