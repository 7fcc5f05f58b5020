"""Neighbours in tilted boxes, counts within blocks, nearest partners and places, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import distributions as dist
from orrery.operators import neighbors, ranks
from orrery.operators.neighbors import cell_pairs, heights, pair_bins, pairs

SCHEMA = "frame int, atom_id long, type int, x double, y double, z double"


def scattered(r, n, box, frames=2, spread=1.4):
    return [(f, f * 1000 + k, r.randrange(1, 4), *(r.uniform(-0.2 * b, spread * b) for b in box)) for f in range(frames) for k in range(n)]


def images(rows, box, tilt, reach, explicit):
    """All images within two boxes of the plain difference; the nearest one or every one within reach."""
    h = np.array([[box[0], 0, 0], [tilt[0], box[1], 0], [tilt[1], tilt[2], box[2]]])
    turns = np.array(list(itertools.product(range(-4, 5), repeat=3))) @ h
    out = []
    for a in rows:
        for b in rows:
            if a[0] == b[0]:
                d = np.array(b[3:]) - np.array(a[3:]) + turns
                r = np.sqrt((d * d).sum(1))
                some = np.flatnonzero((r <= reach) & ((r > 1e-9) | (a[1] != b[1])))
                some = some if explicit else some[np.argsort(r[some])][:1] if a[1] != b[1] else []
                out += [(a[1], b[1], *(round(float(v), 6) + 0.0 for v in (*d[k], r[k]))) for k in some]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_tilted_boxes_equal_all_images(spark, seed):
    r = random.Random(seed)
    box = [r.uniform(6, 9) for _ in range(3)]
    tilt = [r.uniform(-1.3, 1.3) * box[0], r.uniform(-0.9, 0.9) * box[0], r.uniform(-0.9, 0.9) * box[1]]
    rows = scattered(r, 18, box)
    atoms = spark.createDataFrame(rows, SCHEMA)
    lowest = min(heights(box, tilt))
    for explicit, reach in ((False, 0.49 * lowest), (True, 0.9 * lowest)):
        near = pairs(atoms, reach, box, tilt=tilt, images="explicit" if explicit else "minimum")
        got = sorted((x["i"], x["j"], *(round(x[c], 6) + 0.0 for c in ("dx", "dy", "dz", "r"))) for x in near.collect())
        assert got == images(rows, box, tilt, reach, explicit)
    with pytest.raises(ValueError, match="too large"):
        pairs(atoms, 0.51 * lowest, box, tilt=tilt)


def test_tilts_of_each_frame_and_many_blocks(spark, monkeypatch):
    """Boxes as columns, and frames of several blocks, with open axes too."""
    monkeypatch.setattr(neighbors, "WIDEST", 4)
    r = random.Random(7)
    rows = scattered(r, 60, (12.0, 11.0, 13.0))
    atoms = spark.createDataFrame(rows, SCHEMA).withColumn("xy", F.when(F.col("frame") == 0, 5.0).otherwise(-7.0)).withColumn("lx", F.col("frame") + 12.0)
    near = pairs(atoms, 0.9, (F.col("lx"), 11.0, 13.0), tilt=(F.col("xy"), 1.0, -2.0))
    got = sorted((x["i"], x["j"], *(round(x[c], 6) + 0.0 for c in ("dx", "dy", "dz", "r"))) for x in near.collect())
    want = [p for f, xy in ((0, 5.0), (1, -7.0)) for p in images([x for x in rows if x[0] == f], (12.0 + f, 11.0, 13.0), (xy, 1.0, -2.0), 0.9, False)]
    assert got == sorted(want) and len(got) > 8
    open_ = pairs(atoms, 0.9, (12.0, 11.0, 13.0), tilt=(5.0, 1.0, -2.0), periodic=(False, False, False)).select("i", "j").collect()
    assert {tuple(x) for x in open_} == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and math.dist(a[3:], b[3:]) <= 0.9}


def test_cells_and_direct_comparison_agree():
    r = np.random.default_rng(3)
    p, q = r.uniform(0, 10, (300, 3)), r.uniform(0, 10, (200, 3))
    for wrap in ((10.0, 10.0, 10.0), (None, 10.0, None)):
        import orrery.operators.neighbors as n

        direct = {(i, j) for a, b, _ in cell_pairs(p, q, 2.2, wrap, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        before, n.FEW_CELLS = n.FEW_CELLS, 0
        try:
            cells = {(i, j) for a, b, _ in cell_pairs(p, q, 2.2, wrap, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        finally:
            n.FEW_CELLS = before
        assert direct == cells and direct


def test_counts_of_blocks_equal_counts_of_pairs(spark):
    r = random.Random(2)
    atoms = spark.createDataFrame([*scattered(r, 80, (9.0, 9.0, 9.0), spread=1.0), (5, 1, None, 1.0, 1.0, 1.0), (5, 2, 1, 1.0, 1.5, 1.0), (5, 3, 1, None, 1.5, 1.0)], SCHEMA)
    box = (9.0, 9.0, 9.0)
    near = pairs(atoms, 2.0, box)
    plain = near.groupBy("frame", "type_i", "type_j", F.floor(F.col("r") / 0.25).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    got = pair_bins(atoms, 2.0, 0.25, box, per_key=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    plans = [*dist.default_triplets([1, 2, 3], {(1, 2): 1.5, (2, 2): 1.9, (2, 3): 2.0}), dist.Triplet("far", 1, 1, 1, (0.0, 1.0), (1.0, 2.0)), dist.Triplet("none", 9, 1, 1, (0.0, 1.0), (1.0, 2.0))]
    one = dist.angle_distribution(dist.angles(near, plans), 15.0)
    other = dist.binned_angles(dist.angle_bins(atoms, plans, 15.0, box), 15.0)
    rows = lambda df: sorted((x["label"], x["bin"], x["n"], round(x["p"], 9)) for x in df.collect())
    assert rows(one) == rows(other) and len(rows(one)) > 30


def test_places_and_rows_before(spark):
    r = random.Random(1)
    rows = [(r.randrange(3), k, r.randrange(50)) for k in r.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "traj_id int, frame int, timestep int")
    got = {x["frame"]: x["place"] for x in ranks.ranked(df, ["traj_id", F.desc("frame")]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [x[1] for x in sorted(rows, key=lambda x: (x[0], -x[1]))] and sorted(got.values()) == list(range(1, 501))
    want = {}
    for t in range(3):
        last = None
        for _, k, v in sorted(x for x in rows if x[0] == t):
            want[k], last = last, v
    assert {x["frame"]: x["before"] for x in ranks.before(df, "traj_id", "frame", "timestep", block=7).collect()} == want
    steps = {t: sorted({v for a, _, v in rows if a == t}) for t in range(3)}
    assert all(x["d"] == steps[x["traj_id"]].index(x["timestep"]) for x in ranks.dense(df, ["traj_id"], "timestep", "d").collect())


@pytest.mark.parametrize(("n", "m", "apart", "wide"), [(200, 2000, 100, 5), (50, 300, 0, 20), (30, 1, 50, 3), (40, 400, 3, 300)])
def test_nearest_partner_at_any_distance(spark, n, m, apart, wide):
    from orrery.operators.neighbors import partner_distances

    r = random.Random(n)
    shell = [(0, i, 1, *(r.uniform(0, wide) + apart for _ in range(3))) for i in range(n)] + [(1, 5, 1, 0.0, 0.0, 0.0)]
    partners = [(0, i, 1, *(r.uniform(0, wide) for _ in range(3))) for i in range(m)] + [(2, 5, 1, 0.0, 0.0, 0.0), (1, 6, 1, None, 0.0, 0.0)]
    found = partner_distances(spark.createDataFrame(shell, SCHEMA), spark.createDataFrame(partners, SCHEMA), 1.5)
    got = {(x["frame"], x["atom_id"]): x["distance"] for x in found.collect()}
    assert got.pop((1, 5)) == math.inf and len(got) == n
    for f, i, _, *p in shell[:-1]:
        assert got[f, i] == pytest.approx(min(math.dist(p, q[3:]) for q in partners if q[0] == f), abs=1e-9)
