"""Quantiles by digits, sums that keep their digits, and reciprocal points, against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import distributions as dist
from orrery.operators import dynamics, series
from orrery.operators.quantiles import digits_of, quantiles, value_of

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def test_digits_sort_like_doubles():
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(size=2000), r.normal(size=500) * 1e300, r.normal(size=500) * 1e-300, [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324]])
    d = digits_of(v)
    assert (np.lexsort(d[::-1]) == np.argsort(v + 0.0, kind="stable")).all() and (value_of(d) == v).all()


def test_quantiles_equal_numpy(spark):
    r = random.Random(2)
    rows = [("a", r.gauss(0, 1)) for _ in range(777)] + [("b", 1.5)] + [("c", r.choice([-1e300, -2.0, -0.0, 0.0, 3.0, 1e-300])) for _ in range(50)] + [("a", None), ("a", math.nan), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x["k"]: x["q"] for x in quantiles(df, "v", SHARES, ["k"]).collect()}
    for k in "abc":
        want = np.quantile([v for a, v in rows if a == k and v is not None and not math.isnan(v)], SHARES)
        assert got[k] == pytest.approx(want.tolist(), rel=1e-12)
    assert set(got) == set("abc") and quantiles(df.limit(0), "v", [0.5]).count() == 0
    whole = quantiles(df, "v", [0.5]).first()["q"][0]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None and not math.isnan(v)], 0.5))


def test_quantiles_of_many_distinct_values(spark):
    df = spark.range(3_000_000).select((F.pmod(F.col("id") * 7919, F.lit(3_000_000)) / 7.0).alias("v"))
    assert quantiles(df, "v", [0.25, 0.999]).first()["q"] == pytest.approx([0.25 * 2_999_999 / 7, 0.999 * 2_999_999 / 7], rel=1e-12)


def test_variances_far_from_zero(spark):
    """A small ripple on a large offset, over several blocks of steps."""
    n, size = 20_000, 100
    m = 1e5 + 0.01 * np.sin(np.arange(n))
    rows = spark.createDataFrame([(0, k, float(v), 0.0, 0.0) for k, v in enumerate(m)], "traj_id long, step long, mx double, my double, mz double")
    found = series.running(rows, block=1 << 12)
    assert found.count() == n
    for name in ("sliding", "binned", "hybrid", "cumulative"):
        got = {x["step"]: x for x in series.averaged(rows, name, size).filter("step % 100 = 99").collect()}
        for step in (99, 4999, n - 1):
            part = m[: step + 1] if name == "cumulative" else m[step - size + 1 : step + 1]
            assert got[step]["variance"] == pytest.approx(part.var() / 3, rel=1e-4) and got[step]["mm"] == pytest.approx(part.mean() ** 2 / 3, rel=1e-12)


def test_reciprocal_points_of_each_cell(spark):
    r = random.Random(3)
    rows = [(f, k, r.randrange(1, 3), *(r.uniform(-3, 15) for _ in range(3)), 8.0 + f, 9.0, 7.0, 2.0 * f, -1.0, 1.5) for f in range(3) for k in range(20)]
    atoms = spark.createDataFrame(rows, "frame int, atom_id long, type int, x double, y double, z double, lx double, ly double, lz double, xy double, xz double, yz double")
    sums: dict = {}
    for f in range(3):
        own = [x for x in rows if x[0] == f]
        lx, ly, lz, xy, xz, yz = own[0][6:]
        back = np.linalg.inv(np.array([[lx, 0, 0], [xy, ly, 0], [xz, yz, lz]])).T
        for p in np.ndindex(9, 9, 9):
            q = 2 * math.pi * (np.array(p) - 4) @ back
            size = math.sqrt(q @ q)
            if 0 < size <= 2.0:
                rho = {t: sum(np.exp(1j * (q @ np.array(x[3:6]))) for x in own if x[2] == t) for t in (1, 2)}
                n = {t: sum(x[2] == t for x in own) for t in (1, 2)}
                for a, b in ((1, 1), (1, 2), (2, 2)):
                    sums.setdefault((a, b, int(size / 0.25)), []).append((rho[a] * rho[b].conjugate()).real / math.sqrt(n[a] * n[b]))
    got = {(x["type_i"], x["type_j"], x["bin"]): (x["n"], x["s"]) for x in dist.reciprocal_cells(atoms, 2.0, 0.25).collect()}
    assert set(got) == set(sums)
    for k, v in sums.items():
        assert got[k][0] == len(v) // 2 and got[k][1] == pytest.approx(np.mean(v), abs=1e-9)


def test_displacements_in_the_current_box(spark):
    rows = [(f, 1, 1, 0.5 + 9.8 * f, 0.0, 0.0, 10.0 - f) for f in range(3)]
    df = spark.createDataFrame(rows, "frame int, atom_id long, type int, x double, y double, z double, lx double")
    got = {x["lag"]: x["msd"] for x in dynamics.msd(df, ("lx", 10.0, 10.0), 3, 1, 3).collect()}
    assert got == pytest.approx({0: 0.0, 1: (9.8 - 9.0) ** 2, 2: (19.6 - 16.0) ** 2})


def plain_peaks(x, y, least):
    out = []
    for i in range(1, len(y) - 1):
        if y[i] > y[i - 1] and y[i] > y[i + 1]:
            left = next((k for k in range(i - 1, -1, -1) if y[k] > y[i]), -1)
            right = next((k for k in range(i + 1, len(y)) if y[k] > y[i]), len(y))
            high = y[i] - max(min(y[left + 1 : i + 1]), min(y[i:right]))
            if high >= least:
                half = y[i] - high / 2
                a = next(k for k in range(i - 1, -1, -1) if y[k] <= half)
                b = next(k for k in range(i + 1, len(y)) if y[k] <= half)
                cut = lambda p, q: x[p] + (half - y[p]) / (y[q] - y[p]) * (x[q] - x[p])  # noqa: B023, E731
                out.append((x[i], y[i], high, cut(a, a + 1), cut(b, b - 1)))
    return out


def test_peaks_equal_their_definition(spark):
    r = random.Random(4)
    curves = {k: [(t * 1.5, float(r.choice([0, 1, 2, 3, 4, 7, r.random()]))) for t in range(n)] for k, n in (("a", 400), ("b", 2), ("c", 1), ("d", 60))}
    curves["e"] = [(float(t), float(t % 7)) for t in range(100)]
    df = spark.createDataFrame([(k, *p) for k, c in curves.items() for p in c], "label string, k double, y double")
    got = series.peaks(df, 0.5).collect()
    for k, c in curves.items():
        want = plain_peaks([a for a, _ in c], [b for _, b in c], 0.5)
        have = sorted((x["k"], x["y"], x["prominence"], x["left"], x["right"]) for x in got if x["label"] == k)
        assert [v for p in have for v in p] == pytest.approx([v for p in want for v in p]), k


def test_peaks_of_a_long_curve_take_linear_time():
    import time

    y = np.random.default_rng(5).normal(size=1_000_000).cumsum() + np.sin(np.arange(1_000_000))
    began = time.perf_counter()
    wall, base = series.walls(y)
    tops = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])) + 1
    series.crossings(np.arange(1e6), y, tops, y[tops] - 1e-3)
    assert time.perf_counter() - began < 20 and (base <= y).all() and (wall < np.arange(1_000_000)).all()
