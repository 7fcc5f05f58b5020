"""Periodic geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minimum_image(d: Column, length: Column | float) -> Column:
    """Displacement to the nearest image in an orthogonal box; halves go to the even multiple."""
    return d - length * F.rint(d / length)


def wrapped(x: Column, length: Column | float, low: Column | float = 0.0) -> Column:
    """Position inside [low, low + length)."""
    return x - length * F.floor((x - low) / length)


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def clamped_acos(x: Column) -> Column:
    return F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))


def triclinic_image(d: Sequence[Column], box: Sequence[Column | float]) -> tuple[list[Column], list[Column]]:
    """Minimum-image vector in a box (lx, ly, lz, xy, xz, yz) with the image counts: z first, then y, then x."""
    lx, ly, lz, xy, xz, yz = box
    x, y, z = d
    nz = F.rint(z / lz)
    x, y, z = x - nz * xz, y - nz * yz, z - nz * lz
    ny = F.rint(y / ly)
    x, y = x - ny * xy, y - ny * ly
    nx = F.rint(x / lx)
    return [x - nx * lx, y, z], [nx, ny, nz]


def inverse(m: Sequence[Sequence[Column]]) -> tuple[list[list[Column]], Column]:
    """Inverse and determinant of a 3x3 matrix of columns."""
    minors = [cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])]
    det = dot(m[0], minors[0])
    return [[minors[j][i] / det for j in range(3)] for i in range(3)], det


def row_times(v: Sequence[Column], m: Sequence[Sequence[Column]]) -> list[Column]:
    """Row vector times matrix."""
    return [dot(v, [m[k][j] for k in range(3)]) for j in range(3)]


def lattice_image(d: Sequence[Column], lattice: Sequence[Sequence[Column]]) -> list[Column]:
    """Minimum image by fractional rounding; lattice: rows are cell vectors."""
    back, _ = inverse(lattice)
    fraction = row_times(d, back)
    return row_times([f - F.rint(f) for f in fraction], lattice)


def lattice_parameters(lx: Column, ly: Column, lz: Column, xy: Column, xz: Column, yz: Column) -> dict[str, Column]:
    """Lengths and angles (degrees) of a tilted box."""
    b, c = norm(xy, ly), norm(xz, yz, lz)
    return {
        "a": lx, "b": b, "c": c,
        "alpha": F.degrees(clamped_acos((xy * xz + ly * yz) / (b * c))), "beta": F.degrees(clamped_acos(xz / c)), "gamma": F.degrees(clamped_acos(xy / b)),
    }


def cell_measures(lattice: Sequence[Sequence[Column]]) -> dict[str, Column]:
    """Volume, areas of the three faces, separations of opposite faces, and the radius of the largest sphere inside."""
    faces = [cross(lattice[1], lattice[2]), cross(lattice[2], lattice[0]), cross(lattice[0], lattice[1])]
    volume = F.abs(dot(lattice[0], faces[0]))
    areas = [norm(*f) for f in faces]
    apart = [volume / a for a in areas]
    out = {"volume": volume} | {f"area_{n}": a for n, a in zip("abc", areas, strict=True)} | {f"height_{n}": h for n, h in zip("abc", apart, strict=True)}
    return out | {"inradius": F.least(*apart) / 2}


def closed_bin(value: Column, low: float, width: float, count: int) -> Column:
    """Equal bins whose last one is closed on the right."""
    return F.least(F.floor((value - low) / width), F.lit(count - 1)).cast("int")


def shell(r1: Column, r2: Column) -> Column:
    return 4 * math.pi / 3 * (r2 * r2 * r2 - r1 * r1 * r1)
