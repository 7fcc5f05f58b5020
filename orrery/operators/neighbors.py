"""Neighbour search by blocks of space and cell lists instead of comparisons of all pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.geometry import AXES

Box = Sequence[Column | float]


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


#: Least and greatest edge of a block in units of the search radius. Atoms of a frame are dealt to blocks, which bounds what
#: one task holds; wide blocks of a short radius spare copies of atoms near faces.
EDGE, WIDEST = 4, 16
#: Pairs that a block is meant to hold, and atoms in a cube of a unit of length (angstrom) in dense matter.
BLOCK_PAIRS, DENSE = 4e6, 0.1
#: Pairs of centers and cells that are looked at together.
TOGETHER = 1 << 20
#: Up to so many cells of a block its atoms are compared without them.
FEW_CELLS = 128
#: Pairs that a search for a center's nearest holds before it drops the farther ones.
HELD_PAIRS = 1 << 21
#: Partners that a cell of partner_distances() holds on the average in its densest group, at most.
CELL_PARTNERS = 128


def spans(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): every place of some spans, and the span it belongs to."""
    which = np.repeat(np.arange(len(starts)), lengths)
    ends = np.cumsum(lengths)
    return which, np.arange(len(which)) - np.repeat(ends - lengths, lengths) + starts[which]


def cell_pairs(centers: np.ndarray, wings: np.ndarray, reach: float, wrap: Sequence[float | None], explicit: bool, turn: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d) of centers and wings within reach, with the vectors d from i to j, by sorted cells of that size.

    wrap: the box's length on axes that are periodic within the block, whose coordinates lie in [0, length); None on
    others. There the nearest image is taken, or every image with `explicit`. turn: the matrix from differences of these
    coordinates to vectors, which are never shorter in any coordinate; None where both are the same. Few atoms in few cells
    are compared in one go, as most of them are candidates anyway.
    """
    if not len(centers) or not len(wings):
        return
    if not explicit and len(centers) * len(wings) <= TOGETHER and np.prod([max(int(w / reach), 1) if w is not None else np.ptp(wings[:, k]) / reach + 1 for k, w in enumerate(wrap)]) <= FEW_CELLS:
        parts = [wings[None, :, k] - centers[:, None, k] for k in range(3)]
        parts = [x if w is None else x - w * np.rint(x / w) for x, w in zip(parts, wrap, strict=True)]
        if turn is not None:
            parts = [sum(parts[k] * turn[k, c] for k in range(3)) for c in range(3)]
        i, j = np.nonzero(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2] <= reach * reach * (1 + 1e-9))
        yield i, j, np.stack([x[i, j] for x in parts], 1)
        return
    low = np.minimum(centers.min(0), wings.min(0))
    n, here, there, steps = [], [], [], []
    for k, length in enumerate(wrap):
        if length is None:
            here.append(np.floor((centers[:, k] - low[k]) / reach).astype(np.int64) + 1)
            there.append(np.floor((wings[:, k] - low[k]) / reach).astype(np.int64) + 1)
            n.append(int(max(here[-1].max(), there[-1].max())) + 2)
            steps.append((-1, 0, 1))
        else:
            n.append(max(int(length / reach), 1))
            here.append(np.minimum((centers[:, k] / length * n[-1]).astype(np.int64), n[-1] - 1))
            there.append(np.minimum((wings[:, k] / length * n[-1]).astype(np.int64), n[-1] - 1))
            steps.append((-1, 0, 1) if explicit or n[-1] > 2 else (0, 1)[: n[-1]])
    cell = (there[0] * n[1] + there[1]) * n[2] + there[2]
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    ways = np.array(list(product(*steps)))
    for some in np.split(np.arange(len(centers)), np.arange(0, len(centers), max(TOGETHER // len(ways), 1))[1:]):
        # all cells around each center at once; a small block takes a few calls then instead of some for each cell
        to = [h[some] + ways[:, k, None] for k, h in enumerate(here)]
        image = [np.floor_divide(t, m) if w is not None else None for t, m, w in zip(to, n, wrap, strict=True)]
        to = [t - i * m if i is not None else t for t, i, m in zip(to, image, n, strict=True)]
        target = ((to[0] * n[1] + to[1]) * n[2] + to[2]).ravel()
        image = [i.ravel() if i is not None else None for i in image]
        first = np.searchsorted(cell, target)
        count = np.searchsorted(cell, target, "right") - first
        full = np.flatnonzero(count)
        edges = np.flatnonzero(np.diff(np.cumsum(count[full]) // TOGETHER)) + 1
        for part in np.split(full, edges):
            which, place = spans(first[part], count[part])
            asked, j = part[which], order[place]
            i = some[asked % len(some)]
            d = wings[j] - centers[i]
            for k, length in enumerate(wrap):
                if length is not None:
                    d[:, k] += image[k][asked] * length if explicit else -length * np.rint(d[:, k] / length)
            d = d if turn is None else d @ turn
            near = np.flatnonzero(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= reach * reach * (1 + 1e-9))
            yield i[near], j[near], d[near]


def candidate_cells(centers: np.ndarray, wings: np.ndarray, reach: float, wrap: Sequence[float | None], most: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): centers of a cell and all wings of the cells that may be within reach, by sorted cells of about `most` centers.

    For work on all pairs of both; a wing comes once for a cell of centers, by whatever image. See cell_pairs() for wrap.
    """
    if not len(centers) or not len(wings):
        return
    low = np.minimum(centers.min(0), wings.min(0))
    span = np.maximum(np.maximum(centers.max(0), wings.max(0)) - low, 1e-9)
    edge = 1.001 * reach / min(max(int(reach / (most * float(np.prod(span)) / len(centers)) ** (1 / 3)), 1), 3)
    n, here, there = [], [], []
    for k, length in enumerate(wrap):
        n.append(max(int((span[k] if length is None else length) / edge), 1))
        width = (span[k] * (1 + 1e-12) if length is None else length) / n[k]
        shift = low[k] if length is None else 0.0
        here.append(np.clip(((centers[:, k] - shift) / width).astype(np.int64), 0, n[k] - 1))
        there.append(np.clip(((wings[:, k] - shift) / width).astype(np.int64), 0, n[k] - 1))
    cells = [(c[0] * n[1] + c[1]) * n[2] + c[2] for c in (here, there)]
    order = [np.argsort(c, kind="stable") for c in cells]
    cells = [c[o] for c, o in zip(cells, order, strict=True)]
    starts = np.flatnonzero(np.diff(cells[0], prepend=-1))
    # a cell beyond the reach is skipped; rounding of places may be off by a little
    steps = [int(np.ceil(reach * (1 + 1e-9) / ((span[k] * (1 + 1e-12) if length is None else length) / n[k]))) for k, length in enumerate(wrap)]
    for begin, end in zip(starts, np.append(starts[1:], len(cells[0])), strict=True):
        cell = int(cells[0][begin])
        own = (cell // n[2] // n[1], cell // n[2] % n[1], cell % n[2])
        ways = []
        for k, length in enumerate(wrap):
            near = np.arange(own[k] - steps[k], own[k] + steps[k] + 1)
            ways.append(np.unique(near % n[k]) if length is not None else near[(near >= 0) & (near < n[k])])
        to = ((ways[0][:, None, None] * n[1] + ways[1][:, None]) * n[2] + ways[2]).ravel()
        first = np.searchsorted(cells[1], to)
        _, place = spans(first, np.searchsorted(cells[1], to, "right") - first)
        if len(place):
            for part in np.split(np.arange(begin, end), np.arange(0, end - begin, max(TOGETHER // len(place), 1))[1:]):
                for some in np.split(place, np.arange(0, len(place), TOGETHER)[1:]):
                    yield order[0][part], order[1][some]


def heights(box: Box, tilt: Box) -> list:
    """Separations of opposite faces of a box (lx, ly, lz) with tilts (xy, xz, yz): numbers, or columns if any is one."""
    some = any(isinstance(v, Column) for v in (*box, *tilt))
    root = F.sqrt if some else math.sqrt
    (lx, ly, lz), (xy, xz, yz) = ([lit(v) if some else float(v) for v in x] for x in (box, tilt))
    slant = xy * yz - ly * xz
    return [lx * ly * lz / root(ly * lz * ly * lz + xy * lz * xy * lz + slant * slant), ly * lz / root(lz * lz + yz * yz), lz]


def block_edge(r: float) -> float:
    """Edge of a block in which dense matter has about BLOCK_PAIRS pairs within r."""
    return min(max((BLOCK_PAIRS / (DENSE * DENSE * 4 / 3 * math.pi * r**6)) ** (1 / 3), EDGE), WIDEST) * r


@dataclass(frozen=True)
class Search:
    """What tasks need to find the pairs of a block."""

    r_max: float
    r_min: float
    explicit: bool
    half: bool
    periodic: tuple[bool, ...]
    tilted: bool

    def near(self, block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, d, r): rows of the block that are within reach of each other."""
        sides = [np.flatnonzero(block.column(c).to_numpy()) for c in ("_center", "_wing")]
        found = list(self.within(self.placed(block), *sides, self.r_max))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def placed(self, block: pa.Table) -> tuple:
        """Ids, places, lengths of periodic axes and the matrix of a tilted cell."""
        place = np.stack([block.column(f"_p{k}").to_numpy() for k in range(3)], 1)
        wrap = [block.column(f"_l{k}")[0].as_py() if self.periodic[k] and block.column(f"_n{k}")[0].as_py() == 1 else None for k in range(3)]
        turn = np.array(block.column("_turn")[0].as_py()).reshape(3, 3) if self.tilted else None
        plain = None
        if self.tilted:
            cell = np.array(block.column("_cell")[0].as_py())
            plain = tuple(np.stack([block.column(f"_{n}{k}").to_numpy() for k in range(3)], 1) for n in "ri") + (cell,)
        return block.column("atom_id").to_numpy(), place, wrap, turn, plain

    def within(self, placed: tuple, centers: np.ndarray, wings: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of near() for some rows, up to a radius."""
        ids, place, wrap, turn, plain = placed
        for i, j, d in cell_pairs(place[centers], place[wings], reach, wrap, self.explicit, turn):
            i, j = centers[i], wings[j]
            if plain is not None:  # the given places and whole cell vectors, so that shares of the cell leave no rounding
                (at, moved, (lx, ly, lz, xy, xz, yz)), step = plain, place[j] - place[i]
                # vectors between the places less their given difference tell the whole numbers of cell vectors
                scaled = np.linalg.solve(turn.T, d.T).T
                tall = np.array([lx, ly, lz]) / np.diag(turn)
                n = -np.rint((scaled - step) / tall) + moved[j] - moved[i]
                d = at[j] - at[i]
                d[:, 0] = d[:, 0] - n[:, 2] * xz - n[:, 1] * xy - n[:, 0] * lx
                d[:, 1] = d[:, 1] - n[:, 2] * yz - n[:, 1] * ly
                d[:, 2] = d[:, 2] - n[:, 2] * lz
            r = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
            other = ids[i] < ids[j] if self.half else (ids[i] != ids[j]) | (r > 0) if self.explicit else ids[i] != ids[j]
            keep = np.flatnonzero(other & (r >= self.r_min) & (r <= reach))
            yield i[keep], j[keep], d[keep], r[keep]

    def nearest(self, block: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """near() with each center's nearest alone, ties to smaller ids.

        The radius begins where dense wings give some more than `most`, and is doubled for the centers that lack any, so
        neither time nor memory grows with the pairs within the whole radius.
        """
        placed = self.placed(block)
        ids, place = placed[:2]
        left, wings = (np.flatnonzero(block.column(c).to_numpy()) for c in ("_center", "_wing"))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0))]

        def kept(parts: list) -> tuple:
            i, j, d, r = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids[j], r, i))
            order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < most]
            return i[order], j[order], d[order], r[order]

        room = float(np.prod(np.maximum(np.ptp(place[wings], axis=0), 1e-3 * self.r_max))) if len(wings) else 0.0
        reach = min(max((3 * (most + 1) * room / (math.pi * max(len(wings), 1))) ** (1 / 3), 1e-3 * self.r_max, self.r_min), self.r_max)
        while len(left) and len(wings):
            lacking = []
            for part in np.array_split(left, -(-len(left) // (1 << 16))):
                held = [out[0]]
                for found in self.within(placed, part, wings, reach):
                    held.append(found)
                    if sum(len(x[0]) for x in held) > HELD_PAIRS:
                        held = [kept(held)]
                near = kept(held)
                if reach < self.r_max:
                    full = np.bincount(np.searchsorted(part, near[0]), minlength=len(part)) >= most
                    lacking.append(part[~full])
                    near = tuple(x[full[np.searchsorted(part, near[0])]] for x in near)
                out.append(near)
            left = np.concatenate(lacking) if lacking else left[:0]
            reach = min(2 * reach, self.r_max)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Blocks:
    """Atoms dealt to blocks of space, those near a block's faces to its neighbours too, and the pairs within a block."""

    def __init__(
        self, atoms: DataFrame, r_max: float, box: Box, r_min: float = 0.0, origin: Box = (0.0, 0.0, 0.0), periodic: Sequence[bool] = (True, True, True), images: str = "minimum",
        keys: Sequence[str] = ("frame",), center: Column | None = None, wing: Column | None = None, carry: Sequence[str] = ("type",), half: bool = False, tilt: Box | None = None, edge: float | None = None, halo: float | None = None,
    ) -> None:
        # halo: how far beyond its faces a block knows the atoms; more than r_max where neighbours of neighbours count
        halo = max(halo or r_max, r_max)
        self.search, self.keys = Search(r_max, r_min, images == "explicit", half, tuple(periodic), tilt is not None), list(keys)
        edge = max(edge or block_edge(r_max), 2 * halo)
        most = 1.0 if images == "explicit" else 2.0
        used = [F.coalesce(c, F.lit(False)) if c is not None else F.lit(True) for c in (center, wing)]
        rows = atoms.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
        place = [F.col(axis).cast("double") - lit(low) for axis, low in zip(AXES, origin, strict=True)]
        lengths: Sequence = box
        if tilt is not None:
            # coordinates along the cell's vectors, in units in which opposite faces are as far apart as in space
            (lx, ly, lz), (xy, xz, yz) = ([lit(v) for v in x] for x in (box, tilt))
            lengths = heights(box, tilt)
            sz = place[2] / lz
            sy = (place[1] - sz * yz) / ly
            sx = (place[0] - sy * xy - sz * xz) / lx
            zero, tall = F.lit(0.0), [lit(v) for v in lengths]
            vectors = [(lx, zero, zero), (xy, ly, zero), (xz, yz, lz)]
            place = [s * h for s, h in zip((sx, sy, sz), tall, strict=True)]
            rows = rows.withColumns({f"_r{k}": p for k, p in enumerate((F.col(a).cast("double") - lit(low) for a, low in zip(AXES, origin, strict=True)))})
            rows = rows.withColumn("_cell", F.array(*(lit(v) for v in (*box, *tilt))))
            rows = rows.withColumn("_turn", F.array(*(c / h for row, h in zip(vectors, tall, strict=True) for c in row)))
        rows = rows.select(*keys, "atom_id", *dict.fromkeys([*carry, *AXES]), used[0].alias("_center"), used[1].alias("_wing"), *(p.alias(f"_p{k}") for k, p in enumerate(place)), *(lit(v).alias(f"_l{k}") for k, v in enumerate(lengths)), *(["_turn", "_cell", "_r0", "_r1", "_r2"] if tilt is not None else []), *(F.lit(0.0).alias(f"_i{k}") for k in range(3) if tilt is not None))
        rows = rows.filter(F.col("_center") | F.col("_wing"))
        # columns that are the same for all atoms are told to the tasks instead of dealt with each
        self.same, self.cut = {}, []
        for k, length in enumerate(lengths):
            at = F.col(f"_p{k}")
            if periodic[k]:
                if not isinstance(length, Column) and most * r_max > length:
                    raise ValueError(f"a radius of {r_max} is too large for a periodic edge of {length}")
                size = F.col(f"_l{k}")
                size = F.when(size >= most * r_max, size).otherwise(F.raise_error(F.lit(f"a radius of {r_max} is too large for a periodic edge")).cast("double")) if isinstance(length, Column) else size
                count = F.greatest(F.floor(size / edge), F.lit(1)).cast("int")
                if tilt is not None:  # cell vectors that the place is moved by
                    turns = F.floor(at / size)
                    rows = rows.withColumn(f"_i{k}", (turns + F.when(at - size * turns >= size, 1).otherwise(0)).cast("double"))
                at = at - size * F.floor(at / size)
                at = F.when(at >= size, 0.0).otherwise(at)
            else:
                size, count = F.lit(None).cast("double"), F.lit(1 << 30)
                self.same |= {f"_l{k}": pa.scalar(None, pa.float64()), f"_n{k}": pa.scalar(1 << 30, pa.int32())}
            if periodic[k] and not isinstance(length, Column):
                self.same |= {f"_l{k}": pa.scalar(float(length), pa.float64()), f"_n{k}": pa.scalar(max(math.floor(length / edge), 1), pa.int32())}
            rows = rows.withColumns({f"_p{k}": at, f"_l{k}": size, f"_n{k}": count})
            if periodic[k] and not isinstance(length, Column) and length < 2 * edge:
                rows = rows.withColumns({f"_b{k}": F.lit(0), f"_away{k}": F.lit(0)})
                continue
            self.cut.append(f"_b{k}")
            width = F.col(f"_l{k}") / F.col(f"_n{k}") if periodic[k] else F.lit(edge)
            own = F.floor(F.col(f"_p{k}") / width).cast("int")
            own = F.least(own, F.col(f"_n{k}") - 1) if periodic[k] else own
            inside = F.col(f"_p{k}") - own * width
            several = F.col(f"_n{k}") > 1
            sides = F.array(F.lit(0), F.when(several & (inside <= halo), -1), F.when(several & (width - inside <= halo), 1))
            rows = rows.withColumn("_own", own).withColumn(f"_away{k}", F.explode(F.filter(sides, lambda x: x.isNotNull())))
            to = F.col("_own") + F.col(f"_away{k}")
            if periodic[k]:
                turn = F.floor(to / F.col(f"_n{k}"))
                rows = rows.withColumns({f"_b{k}": F.pmod(to, F.col(f"_n{k}")), f"_p{k}": F.col(f"_p{k}") - turn * F.col(f"_l{k}")} | ({f"_i{k}": F.col(f"_i{k}") + turn} if tilt is not None else {}))
            else:
                rows = rows.withColumn(f"_b{k}", to)
        self.same |= {name: pa.scalar(True) for name, given in (("_center", self.cut or center is not None), ("_wing", wing is not None)) if not given}
        self.rows = rows.drop("_own").withColumn("_center", F.col("_center") & (F.col("_away0") == 0) & (F.col("_away1") == 0) & (F.col("_away2") == 0)).drop("_away0", "_away1", "_away2")

    def fields(self) -> dict[str, StructField]:
        return {f.name: f for f in self.rows.schema.fields}

    def apply(self, kernel: Callable[[pa.Table], pa.Table], shape: StructType | str, used: Sequence[str]) -> DataFrame:
        """A kernel over each block; `used` are the columns of atoms that it reads beside the ids."""
        same, by = self.same, [*self.keys, *self.cut] or ["_b0"]
        own = [c for c in self.rows.columns if c.startswith("_") and c not in same and (c in by or c not in ("_b0", "_b1", "_b2"))]
        rows = self.rows.select(*dict.fromkeys([*self.keys, "atom_id", *used, *own]))

        def whole(block: pa.Table) -> pa.Table:
            return kernel(pa.Table.from_arrays([*block.columns, *(pa.repeat(v, block.num_rows) for v in same.values())], [*block.column_names, *same]))

        return rows.groupBy(*by).applyInArrow(whole, shape)


def pairs(
    atoms: DataFrame, r_max: float, box: Box, r_min: float = 0.0, origin: Box = (0.0, 0.0, 0.0), periodic: Sequence[bool] = (True, True, True),
    images: str = "minimum", keys: Sequence[str] = ("frame",), center: Column | None = None, wing: Column | None = None, carry: Sequence[str] = ("type",), half: bool = False, tilt: Box | None = None, most: int | None = None,
) -> DataFrame:
    """Ordered pairs (keys, i, j, <carry>_i, <carry>_j, dx, dy, dz, r) with r_min <= r <= r_max; the vector goes from i to j.

    images="minimum" takes the nearest image of each pair, and half of every periodic edge must hold r_max. "explicit"
    takes every image within r_max, which may reach the length of the box. `center` and `wing` choose atoms for the two
    sides; `half` keeps i < j only. Atoms with a null coordinate have no neighbours. tilt (xy, xz, yz) makes the box a
    tilted one, however far; then the separations of its faces count instead of its edges. most keeps that many nearest
    neighbours of each center alone, ties to smaller ids, before anything leaves the block.

    Atoms are shuffled once, by frame and block of space; those near a block's faces go to its neighbours too. Within a
    block sorted cells give the candidates, so neither a frame nor its pairs are ever compared as a whole.
    """
    blocks = Blocks(atoms, r_max, box, r_min, origin, periodic, images, keys, center, wing, carry, half, tilt)
    fields, search = blocks.fields(), blocks.search
    shape = [fields[k] for k in keys] + [StructField(s, fields["atom_id"].dataType) for s in "ij"]
    shape += [StructField(f"{c}_{s}", fields[c].dataType) for c in carry for s in "ij"] + [StructField(c, DoubleType()) for c in ("dx", "dy", "dz", "r")]

    def met(block: pa.Table) -> pa.Table:
        i, j, d, r = search.near(block) if most is None else search.nearest(block, most)
        out = {k: block.column(k).take(i) for k in keys} | {"i": block.column("atom_id").take(i), "j": block.column("atom_id").take(j)}
        out |= {f"{c}_{s}": block.column(c).take(x) for c in carry for s, x in (("i", i), ("j", j))}
        return pa.table(out | {f"d{a}": np.ascontiguousarray(d[:, k]) for k, a in enumerate(AXES)} | {"r": r})

    return blocks.apply(met, StructType(shape), carry)


def pair_bins(atoms: DataFrame, r_max: float, width: float, box: Box, by: str = "type", keys: Sequence[str] = ("frame",), per_key: bool = False, **options) -> DataFrame:
    """(<by>_i, <by>_j, bin, n), with per_key also the keys: ordered pairs of pairs() counted by kinds and distance.

    Every block counts its own pairs, and only counts leave it.
    """
    blocks = Blocks(atoms, r_max, box, keys=keys, carry=(by,), **options)
    fields, search = blocks.fields(), blocks.search
    shape = [fields[k] for k in keys] + [StructField(f"{by}_{s}", fields[by].dataType) for s in "ij"] + [StructField("bin", IntegerType()), StructField("n", LongType())]
    bins = math.floor(r_max / width) + 1

    def counted(block: pa.Table) -> pa.Table:
        i, j, _, r = search.near(block)
        kinds = block.column(by).combine_chunks().dictionary_encode()
        code = np.append(kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False), 0)[:-1].astype(np.int64)
        m = len(kinds.dictionary) + 1
        n = np.bincount((code[i] * m + code[j]) * bins + np.floor(r / width).astype(np.int64), minlength=m * m * bins)
        at = np.flatnonzero(n)
        names = pa.concat_arrays([kinds.dictionary, pa.nulls(1, kinds.dictionary.type)])
        kind = {f"{by}_{s}": names.take(pa.array(x)) for s, x in (("i", at // bins // m), ("j", at // bins % m))}
        return pa.table({k: block.column(k).combine_chunks().take(pa.array(np.zeros(len(at), np.int64))) for k in keys} | kind | {"bin": (at % bins).astype(np.int32), "n": n[at]})

    found = blocks.apply(counted, StructType(shape), (by,))
    return found.groupBy(*(keys if per_key else ()), f"{by}_i", f"{by}_j", "bin").agg(F.sum("n").alias("n"))


def bonds(atoms: DataFrame, cutoffs: dict[tuple, float], box: Box, by: str = "type", **options) -> DataFrame:
    """Pairs within their kinds' cutoff (strictly); kinds without a positive cutoff are never bonded."""
    table = {tuple(sorted(k)): v for k, v in cutoffs.items() if v and v > 0}
    near = pairs(atoms, max(table.values()), box, carry=tuple(dict.fromkeys([by, *options.pop("carry", ())])), **options)
    low, high = F.least(f"{by}_i", f"{by}_j"), F.greatest(f"{by}_i", f"{by}_j")
    limit = F.coalesce(*(F.when((low == F.lit(a)) & (high == F.lit(b)), F.lit(float(v))) for (a, b), v in table.items()))
    return near.filter(F.col("r") < limit)


def nearest(near: DataFrame, k: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The k nearest neighbours of each center, ranked from 1; ties to smaller ids."""
    order = Window.partitionBy(*keys, "i").orderBy("r", "j")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def symmetric(near: DataFrame, carry: Sequence[str] = ("type",)) -> DataFrame:
    """Half a list of pairs with its other half."""
    swap = {"i": "j", "j": "i"} | {f"{c}_{a}": f"{c}_{b}" for c in carry for a, b in ("ij", "ji")}
    other = near.select(*((-F.col(c)).alias(c) if c in ("dx", "dy", "dz") else F.col(swap.get(c, c)).alias(c) for c in near.columns))
    return near.unionByName(other)


def partner_distances(shell: DataFrame, partners: DataFrame, reach: float, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, atom_id, distance) to the nearest partner at any distance, infinite where there is none; no periodicity.

    Both sides lie in cells that are halved again and again, down to EDGE times reach, and further while a group has more
    than CELL_PARTNERS partners a cell, so that dense matter costs no more for each atom. At each step a cell of the shell
    keeps the cells of partners that may hold a nearest one: those no farther, by the boxes around the atoms in them, than
    some partner is sure to be. Atoms meet only the partners of the cells that are left, no farther from their cell's box
    than that either, and each gives one row, so no product of both sides is made however far apart they are.
    """
    from ..sources.shared import stored

    sides = [df.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).select(*keys, "atom_id", *AXES) for df in (shell, partners)]
    both = sides[0].withColumn("_of", F.lit(0)).unionByName(sides[1].withColumn("_of", F.lit(1)))
    span = both.groupBy(*keys).agg(F.sum("_of").alias("n"), *(f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    span = span.agg(F.max("n").alias("n"), *(f(f"{n}{a}").alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if span["lox"] is None:
        return shell.select(*keys, "atom_id").withColumn("distance", F.lit(float("inf")))
    extent = max(max(span[f"hi{a}"] - span[f"lo{a}"] for a in AXES), 1e-9)
    levels = min(max(math.ceil(math.log2(extent / (EDGE * reach))), math.ceil(math.log2(max(span["n"], 1) / CELL_PARTNERS) / 3), 0), 20)
    edge = extent / 2**levels * (1 + 1e-12)
    sides = [df.withColumns({f"_c{k}": F.floor((F.col(a) - span[f"lo{a}"]) / edge).cast("int") for k, a in enumerate(AXES)}) for df in sides]
    cell = ["_c0", "_c1", "_c2"]
    boxes = [stored(df.groupBy(*keys, *cell).agg(*(f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))) for df in sides]

    def at(level: int, side: int) -> DataFrame:
        """Cells of a level with the boxes around their atoms, and the cells of the level above that they lie in."""
        name = "ap"[side]
        up = [F.shiftright(c, levels - level).alias(f"{name}{k}") for k, c in enumerate(cell)]
        found = boxes[side].groupBy(*keys, *up).agg(*(f(f"{n}{a}").alias(f"{name}{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
        return found.withColumns({f"_{name}{k}": F.shiftright(f"{name}{k}", 1) for k in range(3)})

    near, far = F.lit(0.0), F.lit(0.0)
    for a in AXES:
        gap = F.greatest(F.lit(0.0), F.col(f"plo{a}") - F.col(f"ahi{a}"), F.col(f"alo{a}") - F.col(f"phi{a}"))
        wide = F.greatest(F.abs(F.col(f"ahi{a}") - F.col(f"plo{a}")), F.abs(F.col(f"phi{a}") - F.col(f"alo{a}")))
        near, far = near + gap * gap, far + wide * wide
    own, met = [f"a{k}" for k in range(3)], [f"p{k}" for k in range(3)]
    pruned = None
    for level in range(levels + 1):
        if pruned is None:
            both = at(level, 0).join(at(level, 1), list(keys))
        else:
            both = pruned.join(at(level, 0), [*keys, *(f"_a{k}" for k in range(3))]).join(at(level, 1), [*keys, *(f"_p{k}" for k in range(3))])
        least = F.min(far).over(Window.partitionBy(*keys, *own))
        left = both.withColumn("_bound", least * (1 + 1e-12)).filter(near <= F.col("_bound"))
        pruned = left.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*own, *met)))
    around = [f"a{n}{a}" for a in AXES for n in ("lo", "hi")]
    pruned = left.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*own, *met)), *around, "_bound")
    asked = sides[0].withColumnsRenamed({c: f"_a{k}" for k, c in enumerate(cell)})
    away = [F.greatest(F.lit(0.0), F.col(f"alo{a}") - F.col(a), F.col(a) - F.col(f"ahi{a}")) for a in AXES]
    given = sides[1].withColumnsRenamed({c: f"_p{k}" for k, c in enumerate(cell)}).join(pruned, [*keys, *(f"_p{k}" for k in range(3))])
    given = given.filter(away[0] * away[0] + away[1] * away[1] + away[2] * away[2] <= F.col("_bound"))
    groups = [*keys, *(f"_a{k}" for k in range(3))]
    given = given.select(*(F.col(c).alias(f"{c}_") for c in groups), *(F.col(a).alias(f"{a}_") for a in AXES))
    types = dict(shell.dtypes)

    def closest(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = (np.stack([t.column(c + end).to_numpy() for c in AXES], 1).astype(float).reshape(-1, 3) for t, end in ((mine, ""), (theirs, "_")))
        best = np.full(len(a), np.inf)
        for k in range(0, len(b), 1024):
            part = b[k : k + 1024]
            step = max(TOGETHER // len(part), 1)
            for n in range(0, len(a), step):
                d = a[n : n + step, None, :] - part[None, :, :]
                best[n : n + step] = np.minimum(best[n : n + step], (d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]).min(1))
        return pa.table({k: mine.column(k) for k in (*keys, "atom_id")} | {"distance": np.sqrt(best)})

    grouped = asked.groupBy(*groups).cogroup(given.groupBy(*(f"{c}_" for c in groups)))
    found = grouped.applyInArrow(closest, ", ".join([*(f"`{k}` {types[k]}" for k in (*keys, "atom_id")), "distance double"]))
    return shell.select(*keys, "atom_id").join(found, [*keys, "atom_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))
