"""Analytic fixtures: lattices, straight lines, waves, spheres, repairs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry
from orrery.operators import bands, distributions, dynamics, neighbors, series, structure, tables, voxels
from orrery.operators.neighbors import pairs

ATOM = "frame int, atom_id long, type int, x double, y double, z double"


@pytest.fixture(scope="module")
def cubic(spark):
    """A simple cubic lattice of 5 x 5 x 5 points."""
    return spark.createDataFrame([(0, 25 * i + 5 * j + k, 1, float(i), float(j), float(k)) for i in range(5) for j in range(5) for k in range(5)], ATOM)


def test_lattice_neighbours(cubic):
    near = neighbors.pairs(cubic, 1.8, (5.0, 5.0, 5.0))
    counts = {round(r["r"], 6): r["n"] for r in near.groupBy(F.round("r", 6).alias("r")).agg((F.count("*") / 125).alias("n")).collect()}
    assert counts == {1.0: 6, round(math.sqrt(2), 6): 12, round(math.sqrt(3), 6): 8}


def test_lattice_angles(cubic):
    near = neighbors.pairs(cubic, 1.2, (5.0, 5.0, 5.0))
    plan = distributions.Triplet("a", 1, 1, 1, (0.0, 1.2), (0.0, 1.2))
    counts = {round(r["theta"]): r["n"] for r in distributions.angles(near, [plan]).groupBy(F.round("theta", 3).alias("theta")).agg(F.count("*").alias("n")).collect()}
    assert counts == {90: 125 * 12, 180: 125 * 3}


@pytest.mark.parametrize("reach", [1.0, 2.6, 4.9])
def test_cell_list_equals_brute_force_with_few_cells(spark, reach):
    r = random.Random(1)
    rows = [(f, 40 * f + k, 1 + k % 2, *(r.uniform(-10, 15) for _ in range(3))) for f in range(2) for k in range(40)]
    atoms = spark.createDataFrame(rows, ATOM)
    got = {(x["i"], x["j"]) for x in neighbors.pairs(atoms, reach, (10.0, 11.0, 12.0)).collect()}
    image = lambda d, n: d - n * round(d / n)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and math.dist([image(q - p, n) for p, q, n in zip(a[3:], b[3:], (10, 11, 12), strict=True)], (0, 0, 0)) <= reach}
    assert got == want
    half = neighbors.pairs(atoms, reach, (10.0, 11.0, 12.0), half=True)
    assert {(x["i"], x["j"]) for x in neighbors.symmetric(half).collect()} == want


def test_explicit_images_in_one_cell(spark):
    atoms = spark.createDataFrame([(0, 1, 1, 1.0, 1.0, 1.0), (0, 2, 1, 3.0, 1.0, 1.0)], ATOM)
    near = neighbors.pairs(atoms, 4.0, (4.0, 4.0, 4.0), images="explicit")
    assert near.filter("i = 1 and j = 2 and abs(r - 2) < 1e-9").count() == 2
    assert near.filter("i = 1 and j = 1").count() == 6


def test_bonds_and_open_faces(spark):
    atoms = spark.createDataFrame([(0, 1, 1, 0.2, 5.0, 5.0), (0, 2, 2, 9.8, 5.0, 5.0), (0, 3, 3, 0.2, 5.5, 5.0)], ATOM)
    found = neighbors.bonds(atoms, {(1, 2): 1.0, (3, 1): 0.4, (2, 3): -1.0}, (10.0, 10.0, 10.0))
    assert {(r["i"], r["j"]) for r in found.collect()} == {(1, 2), (2, 1)}
    assert neighbors.pairs(atoms, 1.0, (10.0, 10.0, 10.0), periodic=(False, True, True)).filter("i = 1 and j = 2").count() == 0


def test_partner_distances(spark):
    shell = spark.createDataFrame([(0, 1, 3, 0.0, 0.0, 0.0), (0, 2, 3, 50.0, 0.0, 0.0), (1, 3, 3, 0.0, 0.0, 0.0)], ATOM)
    partners = spark.createDataFrame([(0, 9, 2, 3.0, 4.0, 0.0)], ATOM)
    got = {r["atom_id"]: r["distance"] for r in neighbors.partner_distances(shell, partners, 1.0).collect()}
    assert got[1] == 5.0 and abs(got[2] - math.dist((50, 0, 0), (3, 4, 0))) < 1e-9 and got[3] == math.inf


def test_uniform_gas_and_running_number(spark):
    r = random.Random(2)
    atoms = spark.createDataFrame([(f, 600 * f + k, 1, *(r.uniform(0, 12) for _ in range(3))) for f in range(3) for k in range(600)], ATOM)
    histogram = distributions.pair_histogram(neighbors.pairs(atoms, 4.0, (12.0, 12.0, 12.0)), 1.0)
    rows = distributions.partial_rdf(histogram, distributions.composition(atoms), 12.0**3, 1.0).orderBy("bin").collect()
    assert all(abs(x["g"] - 1) < 0.1 for x in rows[1:4]) and all(a["cn"] <= b["cn"] for a, b in zip(rows, rows[1:], strict=False))


def test_duplicate_triplets_are_an_error():
    plan = distributions.Triplet("a", 1, 2, 2, (0, 1), (0, 1))
    with pytest.raises(ValueError, match="twice"):
        distributions.unique_labels([plan, plan])
    other = distributions.Triplet("a", 1, 2, 2, (0, 1), (1, 2))
    assert [p.label for p in distributions.unique_labels([plan, other])] == ["a", "a_2"]


TRAJ = "frame int, atom_id long, type int, x double, y double, z double, vx double, vy double, vz double"


def test_straight_lines(spark):
    rows = [(f, a, 1, (0.3 * f) % 10, (9.9 + 0.1 * f) % 10, 5.0, 0.3, 0.1, 0.0) for f in range(12) for a in range(3)]
    traj = spark.createDataFrame(rows, TRAJ)
    got = {r["lag"]: r["msd"] for r in dynamics.msd(traj, (10.0,) * 3, 6, 2, 12).collect()}
    assert got[0] == 0 and all(abs(v - 0.1 * k * k) < 1e-9 for k, v in got.items())
    assert {r["n"] for r in dynamics.msd(traj, (10.0,) * 3, 6, 2, 12, origin_rule="strict").collect()} == {9}
    assert all(abs(r["c"] - 1) < 1e-9 for r in dynamics.vacf(traj, 6, 2, 12).collect())
    curve = spark.createDataFrame([(1, k, 6e-4 * k) for k in range(10)], "type int, lag int, msd double")
    assert abs(dynamics.diffusion(curve, 1.0).first()["d"] - 1) < 1e-9


def test_wave_has_its_peak(spark):
    curve = spark.createDataFrame([(1, k, math.cos(2 * math.pi * 0.1 * k)) for k in range(60)], "type int, lag int, c double")
    top = dynamics.cosine_spectrum(curve, 60, 1.0, 0.01, 30).orderBy(F.desc("g")).first()
    assert top["k"] == 10
    traj = spark.createDataFrame([(k, 1, 1, 0.0, 0.0, 0.0, math.cos(2 * math.pi * k / 8), 0.0, 0.0) for k in range(32)], TRAJ)
    assert dynamics.welch_power(traj, 16, 8).orderBy(F.desc("power")).first()["k"] == 2


def test_survival_ends_at_the_first_gap(spark):
    present = spark.createDataFrame([(f, 1, 2) for f in (0, 1, 3)], "frame int, i long, j long")
    assert [(r["lag"], r["s"]) for r in dynamics.survival(present, 4, 9, 4).orderBy("lag").collect()] == [(0, 1.0), (1, 1.0)]


def test_rotation_and_axes(spark):
    bonds = spark.createDataFrame([(0, 1, 5, 1.0, 0.0, 0.0), (0, 1, 6, 0.0, 1.0, 0.0), (1, 1, 5, 0.0, 1.0, 0.0), (1, 1, 6, -1.0, 0.0, 0.0), (0, 2, 7, 1.0, 0.0, 0.0)], "frame int, i long, j long, dx double, dy double, dz double")
    axes = dynamics.molecule_axes(bonds)
    assert axes.filter("atom_id = 2").count() == 0
    got = {(r["axis"], r["lag"]): (round(r["c1"], 9), round(r["c2"], 9)) for r in dynamics.rotational(axes, 2, 1, 2).collect()}
    assert got[("e1", 0)] == (1, 1) and got[("e1", 1)] == (0, -0.5)


VOX = "frame int, atom_id long, type int, x double, y double, z double, vx double, vy double, vz double, fx double, fy double, fz double"


def test_voxel_of_one_and_of_two_atoms(spark):
    rows = [(0, 1, 1, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 2, 2, 6.0, 1.0, 1.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0), (0, 3, 2, 12.0, 1.0, 1.0, -2.0, 0.0, 0.0, -1.0, 0.0, 0.0)]
    got = {r["ix"]: r for r in voxels.voxel_fields(spark.createDataFrame(rows, VOX), 5.0, (12.0, 5.0, 5.0), F.lit(10.0)).collect()}
    assert got[0]["temperature"] is None and got[0]["voxel_type"] == 2 and got[0]["avg_o_speed"] is None and got[1]["voxel_type"] == 1
    assert got[2]["n"] == 1 and abs(got[2]["number_density"] - 1 / 50) < 1e-12  # the last voxel is cut off by the box
    two = voxels.voxel_fields(spark.createDataFrame(rows, VOX), 15.0, (15.0, 5.0, 5.0), F.lit(10.0)).first()
    vcom = 1 / 3
    thermal = 10 * (1 + 4 + 4) - 30 * vcom**2
    assert abs(two["temperature"] - thermal * voxels.KINETIC / (6 * voxels.BOLTZMANN)) < 1e-6
    assert abs(two["virial_pressure"] - (6 - 12) / (3 * 375) * voxels.BAR) < 1e-6


def test_constant_field_stays_constant(spark):
    rows = [(0, i, j, k, None if (i, j, k) == (2, 2, 2) else 4.0) for i in range(5) for j in range(5) for k in range(5)]
    out = voxels.box_smooth(spark.createDataFrame(rows, "frame int, ix int, iy int, iz int, density double"), (5, 5, 5), ["density"])
    assert out.count() == 125 and {round(r["density"], 9) for r in out.collect()} == {4.0}


def test_sphere_is_recovered(spark):
    points = [(0, 20 - math.sqrt(64 - (y - 5) ** 2 - (z - 5) ** 2), float(y), float(z)) for y in range(2, 9) for z in range(2, 9)] + [(0, 90.0, 5.0, 5.0)]
    first = spark.createDataFrame(points[:-1], "frame int, x double, y double, z double")
    got = voxels.sphere_fit(first, (5.0, 5.0)).first()
    assert abs(got["cx"] - 20) < 1e-6 and abs(got["radius"] - 8) < 1e-6
    flat = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (0, 1.0, 4.0, 3.0)], "frame int, x double, y double, z double")
    assert voxels.sphere_fit(flat, (5.0, 5.0)).first()["cx"] is None


def test_triclinic_images_and_parameters(spark):
    box = [F.lit(v) for v in (10.0, 10.0, 10.0, 2.0, 0.0, 0.0)]
    d, n = geometry.triclinic_image([F.lit(1.0), F.lit(9.0), F.lit(-9.5)], box)
    r = spark.range(1).select(*d, *n).first()
    assert [round(x, 9) for x in r] == [-1.0, -1.0, 0.5, 0, 1, -1]
    p = geometry.lattice_parameters(*box)
    assert abs(spark.range(1).select(p["gamma"]).first()[0] - math.degrees(math.acos(2 / math.sqrt(104)))) < 1e-9
    m = geometry.cell_measures([[F.lit(v) for v in row] for row in ((10.0, 0.0, 0.0), (2.0, 10.0, 0.0), (0.0, 0.0, 4.0))])
    got = spark.range(1).select(m["volume"], m["inradius"]).first()
    assert abs(got[0] - 400) < 1e-9 and abs(got[1] - 2) < 1e-9


def test_transforms_and_refit(spark, cubic):
    box = [(0.0, 4.0)] * 3
    twice = structure.mirror(structure.mirror(cubic, "x", box, velocities=False), "x", box, velocities=False)
    assert twice.exceptAll(cubic.select(twice.columns)).count() == 0
    turned = cubic
    for _ in range(4):
        turned = structure.rotate_y(turned, box, velocities=False)
    assert turned.exceptAll(cubic.select(turned.columns)).count() == 0
    moved = structure.refit(cubic, 0.5).agg(F.min("x"), F.max("lx")).first()
    assert tuple(moved) == (0.5, 5.0)
    with pytest.raises(ValueError, match="below"):
        structure.subset(cubic, (1, 1, 1), (0, 2, 2))


def repaired(spark, rows, **options):
    whole, report = structure.repair_edges(spark.createDataFrame(rows, ATOM), 1.2, (10.0, 10.0, 10.0), **options)
    return {r["atom_id"]: r["z"] for r in whole.collect()}, {r["frame"]: r for r in report.collect()}


def test_edge_repair(spark):
    rows = [(0, k, 1, 5.0, 5.0, 4.0 + k) for k in range(5)] + [(0, 9, 1, 5.0, 5.0, 0.2), (0, 10, 1, 5.0, 5.0, 9.1), (0, 11, 1, 1.0, 1.0, 1.0)]
    out, report = repaired(spark, rows)
    assert abs(out[9] - out[10] - 1.1) < 1e-9
    assert report[0].asDict() == {"frame": 0, "moved_up": 1, "moved_down": 0, "new_free": 0, "moved_twice": 0, "low": 1.0, "high": 1.0, "ok": True}


def test_each_check_of_edge_repair_fails(spark):
    """A frame each: atoms that stay free, one that would be moved twice, and one that ends beyond a face."""
    body = [(f, k, 1, 5.0, 5.0, 4.0 + k) for f in range(3) for k in range(5)]
    deep = [(0, 22, 1, 2.0, 2.0, 0.6), (0, 23, 1, 2.0, 2.0, 9.45)]
    alone, beyond = [(1, 24, 1, 1.0, 1.0, 1.0)], [(2, 25, 1, 5.0, 5.0, 9.0), (2, 26, 1, 5.0, 5.0, 0.1)]
    _, spared = repaired(spark, body + deep + alone + beyond, surface=0.5, refitted=False)
    assert spared[0]["new_free"] == 2 and not spared[0]["ok"] and spared[1]["ok"] and spared[2]["high"] < 0 and not spared[2]["ok"]
    _, every = repaired(spark, body + alone, spare_free=False)
    assert every[1]["moved_twice"] == 1 and every[1]["new_free"] == 1 and not every[1]["ok"] and every[0]["ok"]


def test_orphans_are_removed(spark):
    before = spark.createDataFrame([(0, k, t, 10.0 + x, 10.0, 10.0) for k, (t, x) in enumerate([(2, 0.5), (2, 1.0), (3, 0.7), (3, 2.1), (3, 2.4), (3, 2.9), (2, 3.0)])], ATOM)
    after = structure.sphere(before, (10.0, 10.0, 10.0), 2.0)
    assert structure.stoichiometry(before, after).first()["deficit"] == 3
    kept, tags = structure.remove_orphans(before, after, (10.0, 10.0, 10.0), 2.0)
    assert {r["atom_id"] for r in kept.collect()} == {6} and tags.filter("tag = 'DELETE'").count() == 3
    numbers = {r["old"]: r["new"] for r in structure.renumbered(before).collect()}
    assert numbers == {k: k + 1 for k in range(7)}


def test_comparison(spark, cubic):
    moved = cubic.withColumn("x", F.col("x") + F.when(F.col("atom_id") == 7, 0.5).otherwise(0.0))
    rows = structure.compare(cubic, moved, ((5.0, 0, 0), (0, 5.0, 0), (0, 0, 5.0)), F.lit(1.0)).collect()
    assert all(abs(r["msd"] - 0.25 / 125) < 1e-12 for r in rows) and {r["type"] for r in rows} == {1, None}
    assert structure.most_displaced(cubic, moved, (5.0,) * 3, 1).first()["atom_id"] == 7
    assert abs(structure.center_shift(cubic, moved, F.lit(1.0)).first()["dx"] - 0.004) < 1e-9
    with pytest.raises(ValueError, match="different"):
        structure.compare(cubic, moved.filter("atom_id > 0"), ((5.0, 0, 0), (0, 5.0, 0), (0, 0, 5.0)), F.lit(1.0))


def test_window_strategies(spark):
    rows = spark.createDataFrame([(0, k, float(k % 3), 1.0, 0.0) for k in range(25)], "traj_id long, step long, mx double, my double, mz double")
    assert [series.averaged(rows, s, 10).count() for s in ("sliding", "cumulative", "hybrid", "binned")] == [16, 25, 25, 2]
    assert series.dielectric(rows, 300.0, 1000.0).first()["var_y"] == 0


def test_smoothing_keeps_a_constant(spark):
    flat = spark.createDataFrame([("a", k, 2.0) for k in range(30)], "label string, k int, y double")
    assert {round(r["y"], 9) for r in series.gaussian_smooth(flat, 2.0).collect()} == {2.0}


def test_bands(spark):
    weights = spark.createDataFrame([(0, 1, a, 5) for a in range(4)] + [(0, 2, 0, 7), (0, 2, 0, 3)], "step int, band int, atom int, weight int")
    got = {r["band"]: r["participation"] for r in bands.participation(bands.contributions(weights)).collect()}
    assert got == {1: 4.0, 2: 1.0} and abs(sum(bands.kernel(0.04, 0.005)) - 1) < 1e-12
    assert bands.selected(weights, weights.filter("band = 2")).count() == 2


def test_size_and_json_text(spark):
    rows = spark.createDataFrame([("10M",), ("1.5G",), ("7k",), ("12",), ("x",), (None,)], "t string").select(tables.size_in_bytes(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in rows] == [10 << 20, 3 << 29, 7168, 12, None, None]
    odd = spark.createDataFrame([('Here:\n```json\n{"requirements": [{"id": "1", "type": "code"}]}\n```',), ('[{"id": "2"}]',)], "t string")
    got = odd.select(tables.requirements(F.when(F.col("t").startswith("["), F.col("t")).otherwise(tables.tolerant_json(F.col("t")))).alias("r")).collect()
    assert [r["r"][0]["id"] for r in got] == ["1", "2"]


def test_manifests(spark):
    old = spark.createDataFrame([("a/b", "UPLOADED"), ("ab", "FAILED")], "name string, status string")
    new = tables.insert_absent(old, spark.createDataFrame([("a", "PENDING"), ("ab", "PENDING")], "name string, status string"), ["name"])
    assert {(r["name"], r["status"]) for r in new.collect()} == {("a/b", "UPLOADED"), ("ab", "FAILED"), ("a", "PENDING")}
    done = spark.createDataFrame([("r", "UPLOADED"), ("r", None), ("s", "UPLOADED")], "root string, status string")
    assert {r["root"]: r["done"] for r in tables.all_uploaded(done).collect()} == {"r": False, "s": True}
    notes = spark.createDataFrame([("x", 1, 5), ("x", 2, 7)], "student string, at int, points int")
    assert tables.latest(notes, ["student"], "at").first()["points"] == 7


def brute_pairs(rows, reach, box, images, periodic=(True, True, True)):
    """All ordered pairs of all images, by comparing every atom with every other."""
    out = []
    spread = [(-1, 0, 1) if p else (0,) for p in periodic]
    for i, *p in rows:
        for j, *q in rows:
            found = []
            for step in itertools.product(*spread):
                d = [b - a + s * n for a, b, s, n in zip(p, q, step, box, strict=True)]
                found.append(math.dist(d, (0, 0, 0)))
            near = found if images == "explicit" else [min(found)]
            out += [(i, j, round(r, 6)) for r in near if r <= reach and (i != j or (images == "explicit" and r > 0))]
    return sorted(out)


@pytest.mark.parametrize(
    ("box", "reach", "images", "periodic"),
    [((30.0, 17.0, 40.0), 2.0, "minimum", (True, True, True)), ((9.0, 33.0, 7.0), 2.0, "explicit", (True, True, True)), ((6.0, 5.0, 5.5), 4.9, "explicit", (True, True, True)), ((20.0, 20.0, 20.0), 1.7, "minimum", (False, True, False)), ((8.0, 8.0, 8.0), 4.0, "minimum", (True, True, True))],
)
def test_pairs_of_blocks_equal_brute_force(spark, box, reach, images, periodic):
    """Boxes of several blocks and of one, with atoms on the faces."""
    r = random.Random(7)
    rows = [(k, *(r.choice([0.0, n, r.uniform(0, n), n / 2, n / 2 - 1e-9]) if k % 5 == 0 else r.uniform(0, n) for n in box)) for k in range(220)]
    atoms = spark.createDataFrame([(0, k, "a" if k % 2 else None, x, y, z) for k, x, y, z in rows] + [(0, 999, "n", None, 0.0, 0.0)], "frame int, atom_id long, type string, x double, y double, z double")
    found = pairs(atoms, reach, box, images=images, periodic=periodic)
    assert sorted((p["i"], p["j"], round(p["r"], 6)) for p in found.collect()) == brute_pairs(rows, reach, box, images, periodic)
    assert all(p["type_i"] == ("a" if p["i"] % 2 else None) and p["type_j"] == ("a" if p["j"] % 2 else None) for p in found.limit(50).collect())
    half = pairs(atoms, reach, box, images=images, periodic=periodic, half=True, center=F.col("type") == "a")
    assert sorted((p["i"], p["j"], round(p["r"], 6)) for p in half.collect()) == [x for x in brute_pairs(rows, reach, box, images, periodic) if x[0] < x[1] and x[0] % 2]


def test_a_radius_beyond_the_box_is_an_error(spark):
    atoms = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 0.0)], "frame int, atom_id long, type int, x double, y double, z double")
    with pytest.raises(ValueError, match="too large"):
        pairs(atoms, 5.1, (10.0, 20.0, 20.0))
    with pytest.raises(Exception, match="too large"):
        pairs(atoms.withColumn("l", F.lit(10.0)), 5.1, (F.col("l"), 20.0, 20.0)).collect()
    assert pairs(atoms.limit(0), 1.0, (10.0, 10.0, 10.0)).count() == 0


def test_strings_of_cutoffs():
    from orrery.functions.settings import pair_values, triplets

    longest = pair_values("Si-O:2.2;H-O:1.4")
    assert longest == {("O", "Si"): 2.2, ("H", "O"): 1.4}
    (plan,) = triplets("x:O-Si-O:3.0:0.5::", longest, {("O", "Si"): 0.1}, {"O": 2, "Si": 1})
    assert (plan.label, plan.center, plan.wing_a, plan.r_a, plan.r_c) == ("x", 1, 2, (0.5, 3.0), (0.1, 2.2))
    with pytest.raises(ValueError, match="twice"):
        triplets("x:O-Si-O:::|x:O-Si-O:::", longest, {}, {"O": 2, "Si": 1})


def test_long_series_are_cut_into_blocks(spark):
    """Running sums, less each series' first sample, go on over the borders of blocks."""
    from orrery.operators import series

    r = random.Random(1)
    rows = [(t, 10 * k, r.gauss(0, 1), r.gauss(2, 1), r.gauss(0, 4)) for t in range(2) for k in range(90)]
    samples = spark.createDataFrame(rows, "traj_id long, step long, mx double, my double, mz double")
    sums = {(x["traj_id"], x["step"]): (x["rn"], x["sums"], x["base"]) for x in series.running(samples, block=70).collect()}
    for t in range(2):
        total, own = [0.0] * 6, [x for x in rows if x[0] == t]
        for n, (_, step, *m) in enumerate(own, 1):
            m = [a - b for a, b in zip(m, own[0][2:], strict=True)]
            assert sums[t, step][2] == list(own[0][2:])
            total = [a + b for a, b in zip(total, [*m, *(x * x for x in m)], strict=True)]
            assert sums[t, step][0] == n and all(abs(a - b) < 1e-9 for a, b in zip(sums[t, step][1], total, strict=True))


def test_jet_surface_and_hydronium(spark):
    """A slow silica grain, one hydronium, and water that is fast in one slab and then in another: tip 45 then 35, surface 5 then 8."""
    rows = []
    for frame, grain, fast in ((0, 5.0, 44.5), (1, 8.0, 35.5)):
        rows += [(frame, 1, 1, grain, 6.0, 6.0, 0.0), (frame, 2, 2, 14.0, 31.0, 30.0, 0.0)]
        rows += [(frame, 3 + k, 3, 14.0 + dx, 31.0 + dy, 30.0 + dz, 0.0) for k, (dx, dy, dz) in enumerate(((0.9, 0, 0), (0, 0.9, 0), (0, 0, -0.9)))]
        rows += [(frame, 10 + k, 2, x, 33.0, 27.0, 38.0 if x == fast else 12.0) for k, x in enumerate((25.0, 35.5, 44.5))]
    own = spark.createDataFrame(rows, "frame int, atom_id long, type int, x double, y double, z double, vx double").withColumns({c: F.lit(0.0) for c in ("vy", "vz", "fx", "fy", "fz")})
    box, mass = (50.0, 60.0, 60.0), F.when(F.col("type") == 1, 28.085).when(F.col("type") == 2, 15.999).otherwise(1.008)
    fields = voxels.voxel_fields(own, 10.0, box, mass)
    assert {r["frame"]: r["tip"] for r in voxels.jet_tip(fields, 10.0).collect()} == {0: 45.0, 1: 35.0}
    assert {r["frame"]: r["height"] for r in voxels.surface(own, 10.0, box).collect()} == {0: 5.0, 1: 8.0}
    assert {(r["frame"], r["ix"], r["n"]) for r in voxels.hydronium(own, 10.0, 0.0, (30.0, 30.0), 8.0).collect()} == {(0, 1, 1), (1, 1, 1)}
