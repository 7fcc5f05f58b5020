"""Queries that move, compare and repair structures, and over manifests, spectra and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.settings import pair_column, pair_values, triplets
from ..operators import bands as bd
from ..operators import checks, dynamics, series, structure, tables, voxels
from ..operators import distributions as dist
from ..operators.neighbors import nearest, pairs, symmetric
from ..sources import dumps
from ..sources.shared import scratch
from ..streaming import jobs
from .fields import BIN, FIELDS, PHYSICS, ROUNDED, SIZE, WINDOW, fields, shown
from .fields import T as nudged
from .fields import ORACLE_SQL as FIELD_SQL
from .files import ORACLE_SQL as FILE_SQL
from .motion import CHARGE, DT, LAG, LENGTH, NEAR, STEP, B, C, T
from .spatial import AT, BOX, CUTOFFS, MASS_SQL, PR, L, R, angle_sql, mass
from .views import BANDS_DUCK, DIPOLES, FRAMES, RESULTS, VOXEL_BOX, atoms, bands, dipoles, duck, read, traj, view, vox

XYZ = ("x", "y", "z")


def at(rows, *columns, digits=5):
    return rows.select(*columns, *(R(a, digits).alias(a) for a in XYZ))


def region_predicate(spark, sf):
    """Density of a ring-shaped region told by a free expression."""
    found = structure.region_density(atoms(spark, sf), mass(), where="(x - 10)*(x - 10) + (y - 10)*(y - 10) between 9 and 49 and z < 12", volume=1507.96)
    return found.select("frame", "atoms", R("density").alias("density"))


def frozen_flags(spark, sf):
    return checks.frozen(atoms(spark, sf), "z", 3.5).groupBy("frame", "fixed").agg(F.count("*").alias("n"))


def moved_between(spark, sf):
    """Displacements of every atom from each frame to the next."""
    t = traj(spark, sf)
    then = t.select("atom_id", (F.col("frame") + 1).alias("frame"), *(F.col(a).alias(f"{a}0") for a in XYZ))
    return t.join(then, ["atom_id", "frame"]).select("atom_id", "frame", *((F.col(a) - F.col(f"{a}0")).alias(f"d{a}") for a in XYZ))


SKEW = ((20.0, 0.0, 0.0), (3.0, 21.0, 0.0), (1.0, 2.0, 19.5))


def lattice_images(spark, sf):
    """Nearest images through a general lattice."""
    found = geo.lattice_image([F.col(f"d{a}") for a in XYZ], [[F.lit(v) for v in row] for row in SKEW])
    return moved_between(spark, sf).select("atom_id", "frame", *(R(v, 5).alias(a) for a, v in zip(XYZ, found, strict=True)))


def triclinic_images(spark, sf):
    """Nearest images in a tilted box, with how often each axis was crossed."""
    found, images = geo.triclinic_image([F.col(f"d{a}") for a in XYZ], [F.lit(v) for v in (20.0, 21.0, 19.5, 3.0, 1.0, 2.0)])
    rows = moved_between(spark, sf).select("frame", *(v.alias(a) for a, v in zip(XYZ, found, strict=True)), *(n.alias(f"n{a}") for a, n in zip(XYZ, images, strict=True)))
    return rows.groupBy("frame").agg(*(R(F.sum(a), 3).alias(a) for a in XYZ), *(F.sum(F.abs(f"n{a}")).cast("bigint").alias(f"n{a}") for a in XYZ))


def wrapped_positions(spark, sf):
    """Positions after a drift, wrapped into a box that begins below 0."""
    rows = traj(spark, sf).select("frame", "atom_id", *(geo.wrapped(F.col(a) + F.col("frame") * 3.7, B, -4.0).alias(a) for a in XYZ))
    return at(rows, "frame", "atom_id")


def edge_shift(spark, sf):
    return at(structure.shift(atoms(spark, sf), (F.col("z") < 2) & (F.col("type") != 1), "z", L), "frame", "atom_id")


def refitted(spark, sf):
    found = structure.refit(structure.subset(atoms(spark, sf), (2.0, 2.0, 2.0), (18.0, 15.0, 12.0)), 1.5)
    return found.select("frame", "atom_id", *(R(a).alias(a) for a in XYZ), *(R(f"l{a}").alias(f"l{a}") for a in XYZ))


def carved(spark, sf):
    """Atoms outside a sphere, renumbered from 1 in the order of their ids."""
    rest = structure.sphere(atoms(spark, sf), (10.0, 10.0, 10.0), 7.0)
    return at(rest.join(structure.renumbered(rest, block=1000).withColumnRenamed("old", "atom_id"), "atom_id"), "atom_id", "new")


def mirrored_motion(spark, sf):
    """Positions, velocities and image flags mirrored along x, then turned about y."""
    t = traj(spark, sf).withColumn("ix", (F.col("atom_id") % 5 - 2).cast("int"))
    box = [(-1.0, 19.0), (0.0, 20.0), (0.5, 20.5)]
    m = structure.rotate_y(structure.mirror(t, "x", box, flags=("x",)), [(0.0, 20.0)] * 3)
    return m.select("frame", "atom_id", *(R(a).alias(a) for a in XYZ), *(R(f"v{a}", 3).alias(f"v{a}") for a in XYZ), "ix")


def cells(spark, sf):
    """A tilted box for each customer."""
    k = F.col("c_custkey")
    c = read(spark, sf, "customer")["customer"]
    return c.select(k.alias("id"), (10 + k % 7).cast("double").alias("lx"), (12 + k % 5).cast("double").alias("ly"), (15 + k % 3).cast("double").alias("lz"), ((k % 9 - 4) / 2).alias("xy"), ((k % 5 - 2) / 2).alias("xz"), ((k % 11 - 5) / 2).alias("yz"))


CELL = ("lx", "ly", "lz", "xy", "xz", "yz")


def lattice_measures(spark, sf):
    c = [F.col(n) for n in CELL]
    zero = F.lit(0.0)
    measures = geo.cell_measures([[c[0], zero, zero], [c[3], c[1], zero], [c[4], c[5], c[2]]])
    return cells(spark, sf).select("id", *(R(v, 4).alias(n) for n, v in (geo.lattice_parameters(*c) | measures).items()))


def cell_changes(spark, sf):
    c = [F.col(n) for n in CELL]
    after = [c[0] * 1.01, c[1], c[2] * 0.98, c[3] + 0.1, c[4], c[5] - 0.2]
    return cells(spark, sf).select("id", *(R(v, 5).alias(n) for n, v in structure.cell_changes(c, after).items()))


def visible_voxels(spark, sf):
    """Voxels of a slab with their velocity's length, and their density as a share of its range."""
    f = voxels.magnitude(fields(spark, sf))
    shares = voxels.normalized(f, "density", voxels.display_range(f, "density", 5.0))
    seen = checks.visible(shares, "avg_o_speed", kinds=(1, 2), ix=(2, 6), iz=(0, 8))
    return seen.select("frame", "ix", "iy", "iz", R("vcom", 4).alias("vcom"), R("density", 3).alias("share"))


def adjacency(spark, sf):
    """Half a list of pairs made whole, as each atom's neighbours."""
    whole = symmetric(pairs(atoms(spark, sf), 2.0, BOX, half=True))
    return whole.groupBy("frame", F.col("i").alias("atom_id")).agg(F.count("*").alias("n"), F.min("j").alias("least"), R(F.sum("dx"), 4).alias("dx"))


def two_frames(spark, sf):
    t = traj(spark, sf)
    return t.filter("frame = 0"), t.filter(F.col("frame") == FRAMES - 1)


def structure_compare(spark, sf):
    a, b = two_frames(spark, sf)
    lattice = ((B, 0.0, 0.0), (0.0, B, 0.0), (0.0, 0.0, B))
    return structure.compare(a, b, lattice, mass()).select(F.coalesce("type", F.lit(0)).alias("type"), "atoms", *(R(c, 4).alias(c) for c in ("msd", "rms", "mean")))


def mass_center_shift(spark, sf):
    return structure.center_shift(*two_frames(spark, sf), mass()).select(*(R(f"d{a}", 4).alias(f"d{a}") for a in XYZ))


def most_displaced(spark, sf):
    return structure.most_displaced(*two_frames(spark, sf), (B, B, B)).select("atom_id", R("moved", 4).alias("moved"))


def stoichiometry(spark, sf):
    """What a hole takes from each kind over all frames."""
    a = atoms(spark, sf)
    return structure.stoichiometry(a, structure.sphere(a, (10.0, 10.0, 10.0), 7.0))


def orphan_candidates(spark, sf):
    """Atoms around a hole in all frames as one structure, and which of them go to keep the composition."""
    a = atoms(spark, sf).drop("frame")
    _, tags = structure.remove_orphans(a, structure.sphere(a, (10.0, 10.0, 10.0), 6.0), (10.0, 10.0, 10.0), 6.0, 1.0)
    return tags.groupBy("tag").agg(F.count("*").alias("n"), R(F.sum("distance"), 3).alias("distance"))


def open_faces(spark, sf):
    """Atoms without neighbours where z isn't periodic, among them those that have none at all, and the others."""
    a = atoms(spark, sf)
    there = structure.free_atoms(a, 1.2, BOX, (True, True, False)).withColumn("z_open", F.lit(True))
    lost = structure.free_atoms(a, 1.2, BOX, (True, True, True)).withColumn("lost", F.lit(True))
    both = there.join(lost, ["frame", "atom_id"], "left")
    return both.groupBy("frame").agg(F.count("*").alias("free"), F.count("lost").alias("lost"), F.count_if(F.col("lost").isNull()).alias("mended"))


#: Of each way to repair: cutoff, distance from the face, whether atoms free in the periodic box stay, whether the box is refitted.
REPAIRS = {"spared": (1.8, None, True, True), "near": (1.8, 1.5, True, False), "forced": (1.2, 2.5, False, False)}


def edge_repairs(spark, sf):
    """Faces along z repaired in three ways; each frame's checks."""
    a, out = atoms(spark, sf), None
    for way, (cutoff, surface, spare, refit) in REPAIRS.items():
        _, report = structure.repair_edges(a, cutoff, BOX, surface=surface, spare_free=spare, refitted=refit)
        rows = report.select(F.lit(way).alias("way"), "frame", "moved_up", "moved_down", "new_free", "moved_twice", R("low").alias("low"), R("high").alias("high"), "ok")
        out = rows if out is None else out.unionByName(rows)
    return out


def repaired_edges(spark, sf):
    """Where the repaired atoms lie in their refitted box."""
    whole, _ = structure.repair_edges(atoms(spark, sf), 1.8, BOX)
    return whole.select("frame", "atom_id", *(R(c).alias(c) for c in ("x", "y", "z", "lz")))


def repair_sql(way):
    """Names of the steps of one way to repair, as subqueries."""
    cutoff, surface, spare, refit = REPAIRS[way]
    wrap = lambda d: f"({d}) - {L}e0*floor(({d})/{L}e0 + 0.5e0)"
    met = lambda t, z: f"exists (select 1 from {t} b where b.frame = a.frame and b.atom_id <> a.atom_id and sqrt(pow({wrap('b.x - a.x')}, 2) + pow({wrap('b.y - a.y')}, 2) + pow({z}, 2)) <= {cutoff}e0)"
    lost = f"not {met('atoms', wrap('b.z - a.z'))}" if spare else "false"
    low, high = ("true", "true") if surface is None else (f"z <= {surface}e0", f"z >= {L}e0 - {surface}e0")
    half = f"{L / 2!r}"
    return f"""{way}0 as materialized (select frame, atom_id, x, y, z, {lost} as lost, not {met("atoms", "b.z - a.z")} as free from atoms a),
        {way}1 as materialized (select * exclude (z), (free and not lost and z <= {half} and {low}) as up, case when free and not lost and z <= {half} and {low} then z + {L}e0 else z end as z from {way}0),
        {way}2 as materialized (select *, (not {met(f"{way}1", "b.z - a.z")} and not lost and z > {half} and {high}) as high from {way}1 a),
        {way}3 as materialized (select * exclude (z), (high and not up) as down, (high and up) as twice, case when high and not up then z - {L}e0 else z end as z from {way}2),
        {way}4 as materialized (select *, not {met(f"{way}3", "b.z - a.z")} and not lost as fresh from {way}3 a),
        {way} as (select '{way}' as way, frame, count(*) filter (up) as moved_up, count(*) filter (down) as moved_down, count(*) filter (fresh) as new_free, count(*) filter (twice) as moved_twice,
          {"1e0" if refit else "min(z)"} as lo, {"1e0" if refit else f"{L}e0 - max(z)"} as hi from {way}4 group by frame)"""


def charge_dipoles(spark, sf):
    t = traj(spark, sf).withColumns({f"i{a}": ((F.col("atom_id") * p + F.col("frame")) % 3 - 1).cast("int") for a, p in zip(XYZ, (1, 5, 7), strict=True)})
    charge = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in CHARGE.items()))
    return structure.charge_dipoles(t, charge, (B, B, B)).select("frame", *(R(f"m{a}", 2).alias(f"m{a}") for a in XYZ))


def lone_hydrogens(spark, sf):
    """Hydrogens that are none of the two nearest of any oxygen."""
    a = atoms(spark, sf)
    near = nearest(pairs(a, 3.0, BOX, center=F.col("type") == 2, wing=F.col("type") == 3).filter("r < 3"), 2)
    return structure.unassigned(a, near).groupBy("frame").agg(F.count("*").alias("n"), F.min("atom_id").alias("first"))


def dielectric_by_temperature(spark, sf):
    """Constants of all series of a temperature, by rising temperature."""
    from pyspark.sql import Window

    rows = dipoles(spark, sf).withColumn("temperature", (280 + F.col("traj_id") % 4 * 20).cast("double"))
    found = series.dielectric(rows, F.col("temperature"), 27000.0, keys=("temperature",))
    return found.select("temperature", F.row_number().over(Window.orderBy("temperature")).alias("place"), "n", R("total", 4).alias("total"), R("epsilon", 2).alias("epsilon"))  # one row for each temperature


def hbond_outer_angles(spark, sf):
    near = pairs(atoms(spark, sf), 4.0, BOX, center=F.col("type") == 2, wing=F.col("type") == 3)
    return checks.ranked_angles(near, 3, 4, 18).select("bin", "n", R("p").alias("p"))


def neighbour_counts(spark, sf):
    """Mean numbers of hydrogens near an oxygen, below two distances."""
    a = atoms(spark, sf)
    near = pairs(a, 2.8, BOX, center=F.col("type") == 2, wing=F.col("type") == 3)
    return checks.counts_below(near, a.filter("type = 2"), (2.46, 2.8)).select("frame", R("below_1").alias("below_1"), R("below_2").alias("below_2"))


def rot_corr_many(spark, sf):
    """Axes of oxygens with their four nearest hydrogens."""
    near = nearest(pairs(traj(spark, sf), 4.0, (B, B, B), center=F.col("type") == 2, wing=F.col("type") == 3, most=4), 4)
    return dynamics.rotational(dynamics.molecule_axes(near), LENGTH, STEP, FRAMES).select("axis", "lag", R("c1", 4).alias("c1"), R("c2", 4).alias("c2"))


def msd_strict(spark, sf):
    return dynamics.msd(traj(spark, sf), (B, B, B), LENGTH, STEP, FRAMES, origin_rule="strict").select("type", "lag", "n", R("msd", 4).alias("msd"))


EV, POINTS = 0.004, 60


def spectra(spark, sf):
    """Cosine spectra of each kind over energies in eV."""
    c = dynamics.vacf(traj(spark, sf), LENGTH, STEP, FRAMES)
    return dynamics.cosine_spectrum(c, LENGTH, DT, EV / 4.1356677, POINTS)


def vdos_units(spark, sf):
    """Spectra of unit area, over every unit of frequency."""
    g = dynamics.unit_area(spectra(spark, sf), "g", EV)
    return g.select("type", "k", *(R(v, 4).alias(n) for n, v in dynamics.frequency_units(F.col("k") * EV).items()), R("g", 4).alias("g"))


def vdos_phonon(spark, sf):
    """The total spectrum by shares of atoms."""
    counts = traj(spark, sf).filter("frame = 0").groupBy("type").agg(F.count("*").alias("atoms"))
    return dynamics.phonon_weights(spectra(spark, sf), counts).groupBy("k").agg(R(F.sum("g"), 4).alias("g"))


def current_spectrum(spark, sf):
    charge = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in CHARGE.items()))
    c = dynamics.current_correlation(traj(spark, sf), charge, LENGTH, STEP, FRAMES)
    return dynamics.cosine_spectrum(c, LENGTH, DT, 0.02, 50, keys=()).select("k", R("g", 4).alias("g"))


HKL = [(1, 0, 0), (1, 1, 0), (2, 0, 1)]


def sqw_table(spark, sf):
    """S(q, omega) with the self part of each kind, one row for each point and frequency."""
    t = traj(spark, sf)
    whole = dynamics.dynamic_structure(t, B, HKL, LENGTH, FRAMES, DT, 10, 0.3)
    own = dynamics.self_structure(t, B, HKL, LENGTH, STEP, FRAMES, DT, 10, 0.3)
    return dynamics.structure_table(whole, own).select("h", "k", "l", "m", R("thz", 3).alias("thz"), R("s", 4).alias("s"), *(R(f"self_{k}", 4).alias(f"self_{k}") for k in (1, 2, 3)))


NAMES = {"Si": 1, "O": 2, "H": 3}
ARGUMENT = "near:O-Si-O:3.0::3.0:|far:H-O-H:::3.2:2.0|Si-O-H:Si-O-H:2.6:0.5::"
LONGEST, SHORTEST = pair_values("O-Si:2.8;H-O:2.0;H-H:2.4"), pair_values("Si-O:0.2; O-H:0.1")


def argued_angles(spark, sf):
    """Angles whose triplets and cutoffs come as one string."""
    plans = triplets(ARGUMENT, LONGEST, SHORTEST, NAMES)
    return dist.binned_angles(dist.angle_bins(atoms(spark, sf), plans, 10.0, BOX), 10.0).select("label", "bin", "n", R("p").alias("p"))


def pair_strings(spark, sf):
    """Cutoffs of a string for each part, as rows by sorted names."""
    p = read(spark, sf, "part")["part"]
    k = F.col("p_partkey")
    text = F.concat(F.lit("Si-O:"), (k % 30 / 10).cast("string"), F.lit("; H-"), F.element_at(F.array(F.lit("O"), F.lit("H"), F.lit("C")), (k % 3 + 1).cast("int")), F.lit(":"), (k % 20 / 10).cast("string"), F.lit(";"))
    rows = p.select(F.explode(pair_column(text)).alias("pair", "cutoff"))
    return rows.groupBy("pair").agg(F.count("*").alias("n"), R(F.sum("cutoff"), 3).alias("total"))


def box_edges(spark, sf):
    """Mass and cubic edge of the parts that an order's lines put together."""
    l = read(spark, sf, "lineitem")["lineitem"]
    parts = l.select(F.col("l_orderkey").alias("system"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_partkey") % 50 + 1).cast("double").alias("mass"), (F.col("l_linenumber") % 3 + 1).alias("atoms"))
    found = tables.composition_sums(parts, 2.2).withColumn("third", checks.box_edge(F.col("mass"), 2.2, F.lit(10.37), F.lit(11.93)))
    return found.select("system", R("atoms", 3).alias("atoms"), R("mass", 3).alias("mass"), R("edge", 5).alias("edge"), R("third", 3).alias("third"))


def band_region_sets(spark, sf):
    """Bands that the first half of the atoms dominates and that are occupied, by set operations."""
    b = bands(spark, sf)
    first = bd.dominated(b, F.col("atom") < 32).select("band")
    odd = b.filter("band % 3 <> 0").select("band").distinct()
    return first.intersect(odd).withColumn("kind", F.lit("both")).unionByName(first.subtract(odd).withColumn("kind", F.lit("first"))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("band").alias("bands"))


def manifest(spark, sf):
    return read(spark, sf, "lineitem")["lineitem"].select(F.concat(F.lit("root"), (F.col("l_orderkey") % 200).cast("string")).alias("root"), F.when(F.col("l_quantity") > 2, "UPLOADED").when(F.col("l_quantity") == 2, F.lit(None)).otherwise("PENDING").alias("status"))


def all_uploaded(spark, sf):
    return tables.all_uploaded(manifest(spark, sf))


def latest_feedback(spark, sf):
    """What each customer's last order tells."""
    o = read(spark, sf, "orders")["orders"].select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("points"), F.col("o_orderpriority").alias("comment"))
    return tables.latest(o, ["student"], "at").select("student", "comment", "points")


def insert_absent(spark, sf):
    """Names that a manifest lacks, by the exact path and name, though some contain others."""
    t = read(spark, sf, "customer", "supplier")
    have = t["supplier"].select(F.lit("/a").alias("path"), F.concat(F.lit("n"), (F.col("s_suppkey") * 2).cast("string")).alias("name"))
    new = t["customer"].select(F.lit("/a").alias("path"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"))
    return tables.insert_absent(have, new, ["path", "name"])


def dense_frames(spark, sf):
    """Dense numbers of each series' samples."""
    return dumps.numbered(dipoles(spark, sf).withColumn("timestep", F.floor(F.col("step") / 64)), ("traj_id",)).groupBy("traj_id").agg(F.max("frame").alias("last"), F.count("*").alias("n"))


def file_names(spark, sf):
    """Stem, suffix and a safe label of each page's path, and its last number."""
    path = F.element_at(F.split(F.col("url"), "://"), -1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    rows = read(spark, sf, "pages")["pages"].select("page_id", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_replace(path, r"[^A-Za-z0-9]+", "_").alias("label"), dumps.embedded_number(path).alias("number"))
    return rows


def requirement_lists(spark, sf):
    """Requirement lists of both shapes, made of the benchmark's items."""
    b = read(spark, sf, "benchmark")["benchmark"]
    row = F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("text").alias("type"), F.substring("text", 1, 20).alias("description")))
    text = F.when(F.col("item_id") % 2 == 0, F.to_json(row)).otherwise(F.to_json(F.struct(row.alias("requirements"))))
    found = b.select(F.explode(tables.requirements(text)).alias("r"))
    return found.select(F.col("r.id").cast("bigint").alias("item_id"), "r.type", "r.description")


def streamed(spark, sf, strategy, size):
    """The series' samples by a stream with state, in two runs of it."""
    source, out, mark = (scratch(spark) for _ in range(3))
    rows = dipoles(spark, sf)
    # told once: an approximate median that each run told anew, in tasks of any order, would lose samples or give them twice
    half = F.lit(rows.agg(F.expr("percentile_approx(step, 0.5)")).first()[0])
    for part in (F.col("step") <= half, F.col("step") > half):
        rows.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(jobs.SAMPLE).parquet(source)
        jobs.running_averages(stream, strategy, size).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("traj_id", "step", *(nudged(c, d).alias(c) for c, d in (("m2", 4), ("mm", 4), ("variance", 4), ("debye2", 3))))


def stream_sliding(spark, sf):
    return streamed(spark, sf, "sliding", WINDOW)


def stream_cumulative(spark, sf):
    return streamed(spark, sf, "cumulative", WINDOW)


def stream_hybrid(spark, sf):
    return streamed(spark, sf, "hybrid", WINDOW)


def stream_upserts(spark, sf):
    """Results that arrive in three batches, the last of each student."""
    source, out, mark = (scratch(spark) for _ in range(3))
    rows = view(spark, sf, RESULTS).filter("requirement = 'quality'").select("student", "status")
    for k in range(3):
        again = rows if k == 0 else rows.filter(F.col("student").cast("bigint") % (k + 4) == 0).withColumn("status", F.lit(f"AGAIN{k}"))
        again.write.mode("append").json(source)
        jobs.stream_results(spark, source, out, mark, "student string, status string", ["student"]).awaitTermination()
    return jobs.current(spark, out, ["student"])


def stream_windows(spark, sf):
    """Means over windows of simulated time in append mode; samples that come after their window was closed are dropped.

    The series arrive in three parts; then come late samples, one of each series, and a sample far ahead that closes all.
    """
    source, out, mark = (scratch(spark) for _ in range(3))
    own = dipoles(spark, sf)
    last = own.agg(F.max("step")).first()[0]
    third = last // 3
    late = own.filter("step < 16").withColumn("mx", F.col("mx") + 1e6)
    ahead = own.filter("step = 16").limit(1).withColumns({"traj_id": F.lit(-1).cast("bigint"), "step": F.lit(last + 100000).cast("bigint")})
    parts = [own.filter(F.col("step").between(k * third + (k > 0), (k + 1) * third if k < 2 else last)) for k in range(3)]
    gone = 0
    for part in [*parts, late, ahead, ahead.withColumn("step", F.col("step") + 1)]:
        part.write.mode("append").parquet(source)
        stream = jobs.windowed_steps(spark.readStream.schema(jobs.SAMPLE).parquet(source), 0.5, 100, 50)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        gone += jobs.dropped(query)
    found = spark.read.parquet(out).filter("traj_id >= 0")
    return found.select("traj_id", (F.unix_timestamp(F.col("window")["start"]) / 100).cast("bigint").alias("at"), "n", R("mx", 4).alias("mx"), F.lit(gone).alias("dropped"))


def stream_dump_voxels(spark, sf):
    """Voxel fields of dump files that come into a folder in three steps, the query started again for each."""
    source, out, mark = (scratch(spark) for _ in range(3))
    own = vox(spark, sf)
    columns = ("atom_id", "type", "x", "y", "z", "vx", "vy", "vz", "fx", "fy", "fz")
    process = lambda a: voxels.voxel_fields(a.withColumnRenamed("timestep", "frame"), SIZE, VOXEL_BOX, mass()).withColumnRenamed("frame", "timestep")
    edges = [F.lit(0.0).alias(f"{a}lo") for a in "xyz"] + [F.lit(v).alias(f"{a}hi") for a, v in zip("xyz", VOXEL_BOX, strict=True)]
    for some in ("frame < 3", "frame = 3", "frame > 3"):
        part = own.filter(some)
        heads = part.select("frame").distinct().select("frame", F.col("frame").cast("bigint").alias("timestep"), *edges)
        dumps.dump_parts(part, heads, columns).select("value").write.mode("append").text(source)  # a frame is no single row
        jobs.stream_dumps(spark, source, out, mark, process, columns).awaitTermination()
    return spark.read.parquet(out).select(F.col("timestep").cast("int").alias("frame"), "ix", "iy", "iz", "n", R("density", ROUNDED["density"]).alias("density"), "voxel_type")


def averaged_by_name(spark, sf):
    """The strategy told by its name."""
    return shown(series.averaged(dipoles(spark, sf), "binned", BIN, **PHYSICS)).select("traj_id", "step", "epsilon")


QUERIES = {f.__name__: f for f in (
    region_predicate, frozen_flags, lattice_images, triclinic_images, wrapped_positions, edge_shift, refitted, carved, mirrored_motion, lattice_measures, cell_changes, visible_voxels, adjacency, structure_compare,
    mass_center_shift, most_displaced, stoichiometry, orphan_candidates, open_faces, edge_repairs, repaired_edges, charge_dipoles, lone_hydrogens, dielectric_by_temperature, hbond_outer_angles, neighbour_counts, rot_corr_many, msd_strict,
    vdos_units, vdos_phonon, current_spectrum, sqw_table, argued_angles, pair_strings, box_edges, band_region_sets, all_uploaded, latest_feedback, insert_absent, dense_frames, file_names, requirement_lists,
    stream_sliding, stream_cumulative, stream_hybrid, stream_upserts, stream_windows, stream_dump_voxels, averaged_by_name,
)}

POS = "round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(z, 5) + 0e0 as z"
D = f"d as ({duck(DIPOLES)})"
MOVED = f"{T}, mv as (select b.atom_id, b.frame, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz from traj a join traj b on a.atom_id = b.atom_id and b.frame = a.frame + 1)"
CELLS = "c as (select c_custkey as id, 10e0 + c_custkey % 7 as lx, 12e0 + c_custkey % 5 as ly, 15e0 + c_custkey % 3 as lz, (c_custkey % 9 - 4)/2e0 as xy, (c_custkey % 5 - 2)/2e0 as xz, (c_custkey % 11 - 5)/2e0 as yz from customer)"
EVEN = lambda v: f"round_even({v}, 0)"


def params(b):
    """Lengths and angles of a tilted box of six expressions in SQL."""
    lx, ly, lz, xy, xz, yz = b
    lb, lc = f"sqrt({xy}*{xy} + {ly}*{ly})", f"sqrt({xz}*{xz} + {yz}*{yz} + {lz}*{lz})"
    angle = lambda e: f"degrees(acos(greatest(least({e}, 1e0), -1e0)))"
    return {"a": lx, "b": lb, "c": lc, "alpha": angle(f"({xy}*{xz} + {ly}*{yz})/({lb}*{lc})"), "beta": angle(f"{xz}/{lc}"), "gamma": angle(f"{xy}/{lb}")}


AFTER = ("(lx*1.01e0)", "ly", "(lz*0.98e0)", "(xy + 0.1e0)", "xz", "(yz - 0.2e0)")
ENDS = f"{T}, p as (select a.atom_id, a.type, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, " + ", ".join(f"b.{a} - a.{a} - 20e0*floor((b.{a} - a.{a})/20e0 + 0.5e0) as d{a}" for a in XYZ) + f" from traj a join traj b using (atom_id) where a.frame = 0 and b.frame = {FRAMES - 1})"
SPECTRUM = f"{C}, g as (select type, k, sum(c*cos({math.pi / (2 * LENGTH)!r}*lag)*cos({2 * math.pi!r}*k*{EV / 4.1356677!r}*lag*{DT}e0)*{DT}e0) as g from c cross join range(0, {POINTS}) t(k) group by type, k)"
FREE = lambda wrap: f"select a.frame, a.atom_id from atoms a where not exists (select 1 from atoms b where b.frame = a.frame and b.atom_id <> a.atom_id and sqrt(pow(b.x - a.x - {L}e0*floor((b.x - a.x)/{L}e0 + 0.5e0), 2) + pow(b.y - a.y - {L}e0*floor((b.y - a.y)/{L}e0 + 0.5e0), 2) + pow({wrap}, 2)) <= 1.2e0)"
STREAM = lambda name: f"select traj_id, step, m2, mm, variance, debye2 from ({FIELD_SQL[name]})"

ORACLE_SQL = {
    "region_predicate": f"with {AT} select frame, count(*) as atoms, round(sum({MASS_SQL})/1507.96e0*1.6605e0, 5) + 0e0 as density from atoms where (x - 10)*(x - 10) + (y - 10)*(y - 10) between 9 and 49 and z < 12 group by frame",
    "frozen_flags": f"with {AT} select frame, z < 3.5e0 as fixed, count(*) as n from atoms group by all",
    "lattice_images": f"""with {MOVED}, f as (select *, dz/19.5e0 as c from mv), g as (select *, (dy - c*2e0)/21e0 as b from f), h as (select *, (dx - b*3e0 - c*1e0)/20e0 as a from g),
        w as (select atom_id, frame, a - {EVEN("a")} as a, b - {EVEN("b")} as b, c - {EVEN("c")} as c from h)
        select atom_id, frame, round(a*20e0 + b*3e0 + c*1e0, 5) + 0e0 as x, round(b*21e0 + c*2e0, 5) + 0e0 as y, round(c*19.5e0, 5) + 0e0 as z from w""",
    "triclinic_images": f"""with {MOVED}, a as (select *, {EVEN("dz/19.5e0")} as nz from mv), b as (select frame, dx - nz*1e0 as x, dy - nz*2e0 as y, dz - nz*19.5e0 as z, nz from a), c as (select *, {EVEN("y/21e0")} as ny from b),
        d as (select frame, x - ny*3e0 as x, y - ny*21e0 as y, z, nz, ny from c), e as (select *, {EVEN("x/20e0")} as nx from d)
        select frame, round(sum(x - nx*20e0), 3) + 0e0 as x, round(sum(y), 3) + 0e0 as y, round(sum(z), 3) + 0e0 as z, cast(sum(abs(nx)) as bigint) as nx, cast(sum(abs(ny)) as bigint) as ny, cast(sum(abs(nz)) as bigint) as nz from e group by frame""",
    "wrapped_positions": f"with {T}, m as (select frame, atom_id, " + ", ".join(f"{a} + frame*3.7e0 as {a}" for a in XYZ) + " from traj) select frame, atom_id, " + ", ".join(f"round({a} - 20e0*floor(({a} + 4e0)/20e0), 5) + 0e0 as {a}" for a in XYZ) + " from m",
    "edge_shift": f"with {AT} select frame, atom_id, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(case when z < 2 and type <> 1 then z + {L}e0 else z end, 5) + 0e0 as z from atoms",
    "refitted": f"""with {AT}, s as (select * from atoms where x between 2 and 18 and y between 2 and 15 and z between 2 and 12), e as (select frame, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from s group by frame)
        select frame, atom_id, """ + ", ".join(f"round({a} - {a}0 + 1.5e0, 5) + 0e0 as {a}, round({a}1 - {a}0 + 3e0, 5) + 0e0 as l{a}" for a in XYZ) + " from s join e using (frame)",
    "carved": f"with {AT} select atom_id, row_number() over (order by atom_id) as new, {POS} from atoms where sqrt(pow(x - 10, 2) + pow(y - 10, 2) + pow(z - 10, 2)) > 7e0",
    "mirrored_motion": f"with {T} select frame, atom_id, round(z - 0.5e0, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(20e0 - (19e0 - x), 5) + 0e0 as z, round(vz, 3) + 0e0 as vx, round(vy, 3) + 0e0 as vy, round(vx, 3) + 0e0 as vz, cast(-(atom_id % 5 - 2) as int) as ix from traj",
    "lattice_measures": f"""with {CELLS} select id, {", ".join(f"round({e}, 4) + 0e0 as {n}" for n, e in params(CELL).items())}, round(lx*ly*lz, 4) + 0e0 as volume,
        round(sqrt(pow(ly*lz, 2) + pow(xy*lz, 2) + pow(xy*yz - ly*xz, 2)), 4) + 0e0 as area_a, round(sqrt(pow(lz*lx, 2) + pow(yz*lx, 2)), 4) + 0e0 as area_b, round(lx*ly, 4) + 0e0 as area_c,
        round(lx*ly*lz/sqrt(pow(ly*lz, 2) + pow(xy*lz, 2) + pow(xy*yz - ly*xz, 2)), 4) + 0e0 as height_a, round(lx*ly*lz/sqrt(pow(lz*lx, 2) + pow(yz*lx, 2)), 4) + 0e0 as height_b, round(lz, 4) + 0e0 as height_c,
        round(least(lx*ly*lz/sqrt(pow(ly*lz, 2) + pow(xy*lz, 2) + pow(xy*yz - ly*xz, 2)), lx*ly*lz/sqrt(pow(lz*lx, 2) + pow(yz*lx, 2)), lz)/2e0, 4) + 0e0 as inradius from c""",
    "cell_changes": f"with {CELLS} select id, round((1.01e0*0.98e0*lx*ly*lz - lx*ly*lz)/(lx*ly*lz), 5) + 0e0 as volume_change, " + ", ".join(f"round({params(AFTER)[n]} - {params(CELL)[n]}, 5) + 0e0 as d_{n}" for n in ("a", "b", "c", "alpha", "beta", "gamma")) + " from c",
    "visible_voxels": f"""with {FIELDS}, lim as (select frame, quantile_cont(density, 0.05e0) as lo, quantile_cont(density, 0.95e0) as hi from fields group by frame)
        select frame, ix, iy, iz, round(sqrt(vcom_x*vcom_x + vcom_y*vcom_y + vcom_z*vcom_z), 4) + 0e0 as vcom, round(least(greatest((density - lo)/(hi - lo), 0e0), 1e0), 3) + 0e0 as share from fields join lim using (frame)
        where avg_o_speed is not null and voxel_type in (1, 2) and ix between 2 and 6 and iz between 0 and 8""",
    "adjacency": f"with {PR} select frame, i as atom_id, count(*) as n, min(j) as least, round(sum(dx), 4) + 0e0 as dx from pr where r <= 2e0 group by frame, i",
    "structure_compare": f"""with {ENDS}, d as (select type, dx*dx + dy*dy + dz*dz as d2 from p) select coalesce(type, 0) as type, count(*) as atoms, round(avg(d2), 4) + 0e0 as msd, round(sqrt(avg(d2)), 4) + 0e0 as rms, round(avg(sqrt(d2)), 4) + 0e0 as mean from d group by rollup (type)""",
    "mass_center_shift": f"with {ENDS}, m as (select *, {MASS_SQL} as m from p) select round(sum(m*bx)/sum(m) - sum(m*ax)/sum(m), 4) + 0e0 as dx, round(sum(m*by_)/sum(m) - sum(m*ay)/sum(m), 4) + 0e0 as dy, round(sum(m*bz)/sum(m) - sum(m*az)/sum(m), 4) + 0e0 as dz from m",
    "most_displaced": f"with {ENDS}, d as (select atom_id, sqrt(dx*dx + dy*dy + dz*dz) as moved from p) select atom_id, round(moved, 4) + 0e0 as moved from d order by d.moved desc, atom_id limit 5",
    "stoichiometry": f"""with {AT}, g as (select type, count(*) filter (sqrt(pow(x - 10, 2) + pow(y - 10, 2) + pow(z - 10, 2)) <= 7e0) as n from atoms group by type)
        select cast(2*sum(case when type = 2 then n else 0 end) - sum(case when type = 3 then n else 0 end) as bigint) as deficit, cast(sum(case when type = 1 then n else 0 end) as bigint) as silicon_lost from g""",
    "orphan_candidates": f"""with {AT}, q as (select atom_id, type, x, y, z, sqrt((x - 10)*(x - 10) + (y - 10)*(y - 10) + (z - 10)*(z - 10)) as r from atoms),
        cnt as (select 2*count(*) filter (type = 2 and r <= 6e0) - count(*) filter (type = 3 and r <= 6e0) as deficit from q), want as (select case when deficit > 0 then deficit else (-deficit) % 2 end as h, case when deficit > 0 then 0 else (-deficit) // 2 end as o from cnt),
        wide as (select k, 6e0 + (1e0 + k*0.1e0) as w from range(0, 6) t(k)), held as (select k, w, count(*) filter (type = 2 and r > 6e0 and r <= w) as o, count(*) filter (type = 3 and r > 6e0 and r <= w) as h from wide cross join q group by k, w),
        pick as (select coalesce(min(held.w) filter (held.o >= want.o and held.h >= want.h), max(held.w)) as w from held cross join want), sh as (select q.* from q cross join pick where r > 6e0 and r <= pick.w), rest as (select * from q where r > 6e0),
        d2 as (select a.atom_id, min(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2))) as distance from sh a join rest b on a.type = 2 and b.type = 3 group by 1),
        o as (select d2.*, row_number() over (order by distance desc, atom_id) <= (select o from want) as gone from d2),
        d3 as (select a.atom_id, min(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2))) as distance from sh a join rest b on a.type = 3 and b.type = 2 and b.atom_id not in (select atom_id from o where gone) group by 1),
        h as (select d3.*, row_number() over (order by distance desc, atom_id) <= (select h from want) as gone from d3)
        select case when gone then 'DELETE' else 'KEEP' end as tag, count(*) as n, round(sum(distance), 3) + 0e0 as distance from (select * from o union all select * from h) group by 1""",
    "open_faces": f"""with {AT}, o as ({FREE("b.z - a.z")}), w as ({FREE(f"b.z - a.z - {L}e0*floor((b.z - a.z)/{L}e0 + 0.5e0)")})
        select o.frame, count(*) as free, count(w.atom_id) as lost, count(*) - count(w.atom_id) as mended from o left join w using (frame, atom_id) group by o.frame""",
    "edge_repairs": f"""with {AT}, {", ".join(repair_sql(w) for w in REPAIRS)}, every as ({" union all ".join(f"select * from {w}" for w in REPAIRS)})
        select way, frame, moved_up, moved_down, new_free, moved_twice, round(lo, 5) + 0e0 as low, round(hi, 5) + 0e0 as high, (new_free = 0 and moved_twice = 0 and lo > 0 and hi > 0) as ok from every""",
    "repaired_edges": f"""with {AT}, {repair_sql("spared")}, e as (select frame, min(x) as x0, min(y) as y0, min(z) as z0, max(z) as z1 from spared3 group by frame)
        select frame, atom_id, round(x - x0 + 1e0, 5) + 0e0 as x, round(y - y0 + 1e0, 5) + 0e0 as y, round(z - z0 + 1e0, 5) + 0e0 as z, round(z1 - z0 + 2e0, 5) + 0e0 as lz from spared3 join e using (frame)""",
    "charge_dipoles": f"with {T} select frame, " + ", ".join(f"round(sum((case type when 1 then 2.4e0 when 2 then -1.2e0 else 0.6e0 end)*({a} + ((atom_id*{p} + frame) % 3 - 1)*20e0)), 2) + 0e0 as m{a}" for a, p in zip(XYZ, (1, 5, 7), strict=True)) + " from traj group by frame",
    "lone_hydrogens": f"""with {PR}, k as (select frame, j, row_number() over (partition by frame, i order by r, j) as rank from pr where type_i = 2 and type_j = 3 and r < 3e0)
        select frame, count(*) as n, min(atom_id) as first from atoms where type = 3 and (frame, atom_id) not in (select frame, j from k where rank <= 2) group by frame""",
    "dielectric_by_temperature": f"""with {D}, t as (select cast(280 + traj_id % 4*20 as double) as temperature, count(*) as n, (avg(mx*mx) - pow(avg(mx), 2) + avg(my*my) - pow(avg(my), 2) + avg(mz*mz) - pow(avg(mz), 2))/3e0 as total from d group by 1)
        select temperature, cast(row_number() over (order by temperature) as int) as place, n, round(total, 4) + 0e0 as total, round(total*{series.DIELECTRIC!r}/(temperature*27000e0), 2) + 0e0 as epsilon from t""",
    "hbond_outer_angles": f"""with {PR}, k as (select *, row_number() over (partition by frame, i order by r, j) as rank from pr where type_i = 2 and type_j = 3 and r <= 4e0),
        t as (select degrees(acos(greatest(least((a.dx*b.dx + a.dy*b.dy + a.dz*b.dz)/(a.r*b.r), 1e0), -1e0))) as theta from k a join k b on a.frame = b.frame and a.i = b.i and a.rank = 3 and b.rank = 4)
        select cast(least(floor(theta/10e0), 17) as int) as bin, count(*) as n, round(count(*)/(select count(*) from t), 5) + 0e0 as p from t group by 1""",
    "neighbour_counts": f"""with {PR}, n as (select frame, count(*) filter (r < 2.46e0) as a, count(*) filter (r < 2.8e0) as b from pr where type_i = 2 and type_j = 3 and r <= 2.8e0 group by frame), o as (select frame, count(*) as n from atoms where type = 2 group by frame)
        select frame, round(coalesce(a, 0)/o.n, 5) + 0e0 as below_1, round(coalesce(b, 0)/o.n, 5) + 0e0 as below_2 from o left join n using (frame)""",
    "rot_corr_many": f"""with {NEAR}, k as (select *, row_number() over (partition by frame, i order by r, j) as rank from pr where r <= 4e0), mol as (select frame, i, count(*) as n, {", ".join(f"sum(d{a}) as t{a}, list(d{a} order by j) as l{a}" for a in XYZ)} from k where rank <= 4 group by all),
        ax as (select frame, i, 'e1' as axis, {", ".join(f"case when n > 2 then t{a} else l{a}[1] end as {a}" for a in XYZ)} from mol where n >= 2 union all select frame, i, 'e2', {", ".join(f"case when n > 2 then l{a}[1] else l{a}[2] - l{a}[1] end" for a in XYZ)} from mol where n >= 2
          union all select frame, i, 'e3', {", ".join(f"l{a}[2] - l{a}[1]" for a in XYZ)} from mol where n >= 2),
        u as (select frame, i, axis, x/sqrt(x*x + y*y + z*z) as x, y/sqrt(x*x + y*y + z*z) as y, z/sqrt(x*x + y*y + z*z) as z from ax), g as (select a.axis, b.frame - a.frame as lag, a.x*b.x + a.y*b.y + a.z*b.z as c from u a join u b using (i, axis)
        where a.frame % {STEP} = 0 and a.frame <= {FRAMES - LENGTH} and b.frame - a.frame between 0 and {LENGTH - 1}) select axis, cast(lag as int) as lag, round(avg(c), 4) + 0e0 as c1, round(avg((3*c*c - 1)/2), 4) + 0e0 as c2 from g group by axis, lag""",
    "msd_strict": f"with {LAG} select type, cast(lag as int) as lag, count(*) as n, round(avg(d2), 4) + 0e0 as msd from lags where ref < {FRAMES - LENGTH} group by all",
    "vdos_units": f"""with {SPECTRUM}, a as (select type, sum(g)*{EV}e0 as area from g group by type) select type, cast(k as int) as k, round(k*{EV}e0, 4) + 0e0 as ev, round(k*{EV * 1000}e0, 4) + 0e0 as mev, round(k*{EV}e0/0.0041356677e0, 4) + 0e0 as thz,
        round(k*{EV}e0/0.0041356677e0/0.0299792458e0, 4) + 0e0 as per_cm, round(g/area, 4) + 0e0 as g from g join a using (type)""",
    "vdos_phonon": f"with {SPECTRUM}, n as (select type, count(*) as n from traj where frame = 0 group by type) select cast(k as int) as k, round(sum(g*6e0/{math.pi!r}*n/(select sum(n) from n)), 4) + 0e0 as g from g join n using (type) group by k",
    "current_spectrum": f"""with {T}, j as (select frame, {", ".join(f"sum((case type when 1 then 2.4e0 when 2 then -1.2e0 else 0.6e0 end)*v{a}) as j{a}" for a in XYZ)} from traj group by frame),
        c as (select b.frame - a.frame as lag, sum(a.jx*b.jx + a.jy*b.jy + a.jz*b.jz)/sum(a.jx*a.jx + a.jy*a.jy + a.jz*a.jz) as c from j a join j b on a.frame % {STEP} = 0 and a.frame <= {FRAMES - LENGTH} and b.frame - a.frame between 0 and {LENGTH - 1} group by 1)
        select cast(k as int) as k, round(sum(c*cos({math.pi / (2 * LENGTH)!r}*lag)*cos({2 * math.pi!r}*k*0.02e0*lag*{DT}e0)*{DT}e0), 4) + 0e0 as g from c cross join range(0, 50) t(k) group by k""",
    "sqw_table": f"""with {T}, pt(h, k, l) as (values (1, 0, 0), (1, 1, 0), (2, 0, 1)), w as (select frame, h, k, l, sum(cos({2 * math.pi / B!r}*(h*x + k*y + l*z))) as c, sum(sin({2 * math.pi / B!r}*(h*x + k*y + l*z))) as s, count(*) as n from traj cross join pt group by all),
        f as (select a.h, a.k, a.l, b.frame - a.frame as lag, avg((a.c*b.c + a.s*b.s)/b.n) as f from w a join w b on a.h = b.h and a.k = b.k and a.l = b.l and a.frame <= {FRAMES - LENGTH} and b.frame - a.frame between 0 and {LENGTH - 1} group by all),
        o as (select a.type, h, k, l, b.frame - a.frame as lag, avg(cos({2 * math.pi / B!r}*(h*(b.x - a.x) + k*(b.y - a.y) + l*(b.z - a.z)))) as f from traj a join traj b using (atom_id) cross join pt where a.frame % {STEP} = 0 and a.frame <= {FRAMES - LENGTH} and b.frame - a.frame between 0 and {LENGTH - 1} group by all),
        u as (select 0 as type, * from f union all select * from o),
        z as (select type, h, k, l, m, sum(case when lag = 0 then 1e0 else 2e0 end*cos({math.pi / (2 * LENGTH)!r}*lag)*f*cos(m*0.3e0*lag*{DT}e0)*{DT}e0/{2 * math.pi!r}) as s from u cross join range(0, 10) t(m) group by all)
        select h, k, l, cast(m as int) as m, round(m*0.3e0*1000e0/{2 * math.pi!r}, 3) + 0e0 as thz, {", ".join(f"round(max(s) filter (type = {t}), 4) + 0e0 as {n}" for t, n in ((0, "s"), (1, "self_1"), (2, "self_2"), (3, "self_3")))} from z group by h, k, l, m""",
    "argued_angles": angle_sql(triplets(ARGUMENT, LONGEST, SHORTEST, NAMES), 3.2, "frame"),
    "pair_strings": """with p as (select p_partkey as k from part), r as (select 'O-Si' as pair, (k % 30)/10e0 as cutoff from p union all select case k % 3 when 0 then 'H-O' when 1 then 'H-H' else 'C-H' end, (k % 20)/10e0 from p)
        select pair, count(*) as n, round(sum(cutoff), 3) + 0e0 as total from r group by pair""",
    "box_edges": """with s as (select l_orderkey as system, sum(cast(l_quantity as double)*(l_linenumber % 3 + 1)) as atoms, sum(cast(l_quantity as double)*(l_partkey % 50 + 1)) as mass from lineitem group by 1)
        select system, round(atoms, 3) + 0e0 as atoms, round(mass, 3) + 0e0 as mass, round(pow(mass*1.6605e0/2.2e0, 1e0/3e0), 5) + 0e0 as edge, round(mass*1.6605e0/2.2e0/(10.37e0*11.93e0), 3) + 0e0 as third from s""",
    "band_region_sets": f"""with b as ({BANDS_DUCK}), f as (select band from b group by band having sum(case when atom < 32 then weight else 0 end)/sum(weight) > 0.5e0)
        select case when band % 3 <> 0 then 'both' else 'first' end as kind, count(*) as n, cast(sum(band) as bigint) as bands from f group by 1""",
    "all_uploaded": "select 'root' || (l_orderkey % 200)::varchar as root, bool_and(l_quantity > 2) as done from lineitem group by 1",
    "latest_feedback": "select o_custkey as student, arg_max(o_orderpriority, o_orderkey) as comment, max(o_orderkey) as points from orders group by o_custkey",
    "insert_absent": "with h as (select 'n' || (s_suppkey*2)::varchar as name from supplier), c as (select 'n' || c_custkey::varchar as name from customer) select '/a' as path, name from h union all select '/a', name from c where name not in (select name from h)",
    "dense_frames": f"with {D} select traj_id, cast(count(distinct step // 64) - 1 as int) as last, count(*) as n from d group by traj_id",
    "file_names": """with p as (select page_id, list_extract(string_split(url, '://'), -1) as path from pages), n as (select page_id, path, regexp_extract(path, '([^/]*)$', 1) as name from p)
        select page_id, regexp_replace(name, '\\.[^.]*$', '') as stem, regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g') as label, try_cast(list_extract(regexp_extract_all(name, '(\\d+)', 1), -1) as bigint) as number from n""",
    "requirement_lists": "select cast(item_id as bigint) as item_id, 'text' as type, substr(text, 1, 20) as description from benchmark",
    "stream_sliding": STREAM("dipole_windowed"),
    "stream_cumulative": STREAM("dipole_cumulative"),
    "stream_hybrid": STREAM("dipole_hybrid"),
    "stream_upserts": f"""with res as ({duck(RESULTS)}) select student, case when student::bigint % 6 = 0 then 'AGAIN2' when student::bigint % 5 = 0 then 'AGAIN1' else status end as status from res where requirement = 'quality'""",
    "stream_windows": f"with {D} select traj_id, step // 200 as at, count(*) as n, round(avg(mx), 4) + 0e0 as mx, 16 as dropped from d group by 1, 2",
    "stream_dump_voxels": FILE_SQL["stream_voxels"],
    "averaged_by_name": f"select traj_id, step, epsilon from ({FIELD_SQL['dipole_binned']})",
}
