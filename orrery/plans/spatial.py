"""Queries over the snapshots: pairs, distributions and structures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import distributions as dist
from ..operators import structure, voxels
from ..operators.neighbors import bonds, heights, nearest, pair_bins, pairs, partner_distances
from .views import ATOM_BOX, ATOMS, atoms, duck

L, REACH, WIDTH = ATOM_BOX, 5.0, 0.5
BOX = (L, L, L)
VOLUME = L**3
MASS = {1: 28.0855, 2: 15.9994, 3: 1.00794}
#: Neutron scattering lengths (fm) of Si, O and H.
LENGTHS = {1: 4.1491, 2: 5.803, 3: -3.739}
CUTOFFS = {(1, 2): 2.6, (2, 2): 2.8, (2, 3): 2.2, (1, 3): 3.0}
FACTORS = {
    1: ((6.2915, 3.0353, 1.9891, 1.541), (2.4386, 32.3337, 0.6785, 81.6937), 1.1407),
    2: ((3.0485, 2.2868, 1.5463, 0.867), (13.2771, 5.7011, 0.3239, 32.9089), 0.2508),
    3: ((0.489918, 0.262003, 0.196767, 0.049879), (20.6593, 7.74039, 49.5519, 2.20159), 0.001305),
}


def R(c, digits=5):
    return F.round(c, digits) + F.lit(0.0)


def mass(kind="type"):
    return F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in MASS.items()))


MASS_SQL = "case type " + " ".join(f"when {k} then {v}e0" for k, v in MASS.items()) + " end"
LEN = f"{L}e0"


def near(spark, sf, r=REACH, **options):
    return pairs(atoms(spark, sf), r, BOX, **options)


AT = f"atoms as ({duck(ATOMS)})"
PR = f"""{AT}, pr as (select *, sqrt(dx*dx + dy*dy + dz*dz) as r from (select a.frame, a.atom_id as i, b.atom_id as j, a.type as type_i, b.type as type_j, a.x as x_i, b.x as x_j,
  b.x - a.x - {LEN}*floor((b.x - a.x)/{LEN} + 0.5e0) as dx, b.y - a.y - {LEN}*floor((b.y - a.y)/{LEN} + 0.5e0) as dy, b.z - a.z - {LEN}*floor((b.z - a.z)/{LEN} + 0.5e0) as dz
  from atoms a join atoms b on a.frame = b.frame and a.atom_id <> b.atom_id) d)"""
HIST = f"""{PR}, hist as (select type_i, type_j, cast(floor(r/{WIDTH}e0) as int) as bin, count(*) as n from pr where r <= {REACH}e0 group by all),
  cnt as (select frame, type, count(*) as atoms from atoms group by all),
  norms as (select a.type as type_i, b.type as type_j, sum(a.atoms*b.atoms/{VOLUME!r}) as ideal, sum(a.atoms) as centers from cnt a join cnt b on a.frame = b.frame group by all),
  gr as (select type_i, type_j, bin, (bin + 0.5e0)*{WIDTH}e0 as r, n, n/(ideal*{4 * math.pi / 3!r}*(pow((bin + 1)*{WIDTH}e0, 3) - pow(bin*{WIDTH}e0, 3))) as g,
    sum(n) over (partition by type_i, type_j order by bin)/centers as cn from hist join norms using (type_i, type_j)),
  frac as (select type, count(*) as atoms, count(*)/(select count(*) from atoms) as fraction from atoms group by type)"""
DENSITY = 500 / VOLUME


def histogram(spark, sf):
    return pair_bins(atoms(spark, sf), REACH, WIDTH, BOX)


def partial(spark, sf, **options):
    a = atoms(spark, sf)
    return dist.partial_rdf(histogram(spark, sf), dist.composition(a), VOLUME, WIDTH, **options)


def fractions(spark, sf):
    return dist.concentrations(atoms(spark, sf))


def pair_counts(spark, sf):
    return histogram(spark, sf)


def rdf_partial(spark, sf):
    return partial(spark, sf).select("type_i", "type_j", "bin", "n", R("g").alias("g"), R("cn").alias("cn"))


def coordination_cn(spark, sf):
    return partial(spark, sf, edge="upper").select("type_i", "type_j", "bin", R("r").alias("r"), R("g").alias("g"), R("cn").alias("cn"))


def rdf_total_neutron(spark, sf):
    return dist.total_rdf(partial(spark, sf), fractions(spark, sf), DENSITY, LENGTHS).select("bin", R("g", 4).alias("g"), R("t", 4).alias("t"))


def concentrations(spark, sf):
    return fractions(spark, sf).select("type", "atoms", R("fraction").alias("fraction"))


def first_concentrations(spark, sf):
    """Mole fractions in the first frame alone."""
    return dist.concentrations(atoms(spark, sf), first_frame=True).select("type", "atoms", R("fraction").alias("fraction"))


def neutron_sq(spark, sf):
    """Structure factors of all pairs of kinds weighted by their scattering lengths, which don't depend on q."""
    s = dist.sine_transform(partial(spark, sf), fractions(spark, sf), DENSITY, WIDTH, 0.1, 60)
    return dist.weighted_sq(s, fractions(spark, sf), LENGTHS).select(R("q", 2).alias("q"), R("s", 3).alias("s"))


def water_dipoles_without_first(spark, sf):
    """Dipoles of molecules without the first frame of each file, five frames a file."""
    a = dist.without_first(atoms(spark, sf).withColumn("file", F.floor(F.col("frame") / 5)), "file")
    return structure.molecule_dipoles(a, BOX, 3.0, 0.5).select("frame", "formed", "missing")


def explicit_images(spark, sf):
    """Pairs of one kind within 6 angstrom in every image, on cells of that size."""
    found = near(spark, sf, 6.0, images="explicit", center=F.col("type") == 1, wing=F.col("type") == 3)
    return found.groupBy("frame").agg(F.count("*").alias("n"), R(F.sum("r"), 3).alias("total"))


PLANS = [dist.Triplet("O-Si-O", 1, 2, 2, (0.0, 3.0), (0.0, 3.0)), dist.Triplet("H-O--H", 2, 3, 3, (0.0, 2.0), (2.0, 3.2)), dist.Triplet("Si-O-H", 2, 1, 3, (0.0, 2.6), (0.0, 2.2))]


def bond_angles(spark, sf):
    return dist.binned_angles(dist.angle_bins(atoms(spark, sf), PLANS, 10.0, BOX), 10.0).select("label", "bin", "n", R("p").alias("p"))


def angle_sweep(spark, sf):
    plans = dist.default_triplets([1, 2, 3], CUTOFFS)
    return dist.binned_angles(dist.angle_bins(atoms(spark, sf), plans, 10.0, BOX), 10.0, norm="sum").select("label", "bin", "n", R("p").alias("p"))


def angle_sql(plans, reach, norm):
    values = ", ".join(f"('{p.label}', {p.center}, {p.wing_a}, {p.wing_c}, {p.r_a[0]}e0, {p.r_a[1]}e0, {p.r_c[0]}e0, {p.r_c[1]}e0, {str(p.same_arm).lower()})" for p in plans)
    tail = {
        "frame": "select label, bin, cast(sum(n) as bigint) as n, round(sum(n/(area*10e0))/(select count(distinct frame) from th t where t.label = b.label), 5) + 0e0 as p from (select *, sum(n) over (partition by label, frame) as area from bins) b group by label, bin",
        "sum": "select label, bin, cast(sum(n) as bigint) as n, round(sum(n)/(select sum(n) from bins c where c.label = b.label), 5) + 0e0 as p from bins b group by label, bin",
    }[norm]
    return f"""with {PR}, plans(label, c, wa, wc, a0, a1, c0, c1, same) as (values {values}),
      th as (select p.label, a.frame, degrees(acos(greatest(least((a.dx*b.dx + a.dy*b.dy + a.dz*b.dz)/(a.r*b.r), 1e0), -1e0))) as theta
        from plans p join pr a on a.type_i = p.c and a.type_j = p.wa and a.r between p.a0 and p.a1 and a.r <= {reach}e0
        join pr b on b.frame = a.frame and b.i = a.i and b.type_j = p.wc and b.r between p.c0 and p.c1 and (case when same then a.j < b.j else a.j <> b.j end)),
      bins as (select label, frame, cast(least(floor(theta/10e0), 17) as int) as bin, count(*) as n from th group by all) {tail}"""


def sq_from_gr(spark, sf):
    return dist.sine_transform(partial(spark, sf), fractions(spark, sf), DENSITY, WIDTH, 0.1, 60).select("type_i", "type_j", R("q", 2).alias("q"), R("s", 4).alias("s"))


def xray_sq(spark, sf):
    s = dist.sine_transform(partial(spark, sf), fractions(spark, sf), DENSITY, WIDTH, 0.1, 60)
    factors = {k: (lambda q, v=v: dist.form_factor(q, *v)) for k, v in FACTORS.items()}
    return dist.weighted_sq(s, fractions(spark, sf), factors).select(R("q", 2).alias("q"), R("s", 4).alias("s"))


SQ = f"""{HIST}, sq as (select type_i, type_j, q, {4 * math.pi * DENSITY!r}*sqrt(a.fraction*b.fraction)*sum(r*r*(g - 1)*sin(q*r)/(q*r)*{WIDTH}e0) + case when type_i = type_j then 1e0 else 0e0 end as s
  from gr join frac a on a.type = type_i join frac b on b.type = type_j cross join (select k*0.1e0 as q from range(1, 61) t(k)) grid group by type_i, type_j, q, a.fraction, b.fraction)"""
FORM = lambda c: "case " + c + " " + " ".join(f"when {k} then " + " + ".join([f"{v[2]}e0", *(f"{x}e0*exp(-{y}e0*pow(q/{4 * math.pi!r}, 2))" for x, y in zip(v[0], v[1], strict=True))]) for k, v in FACTORS.items()) + " end"


def debye_sq(spark, sf):
    return dist.debye_sq(histogram(spark, sf), dist.composition(atoms(spark, sf)), WIDTH, 0.25, 20).select("type_i", "type_j", R("q", 2).alias("q"), R("s", 3).alias("s"))


def reciprocal_sq(spark, sf):
    return dist.reciprocal_sq(atoms(spark, sf), L, 3).select("type_i", "type_j", "q2", R("s", 4).alias("s"))


def knn2_dipole(spark, sf):
    return structure.molecule_dipoles(atoms(spark, sf), BOX, 3.0, 0.41).select("frame", *(R(f"m{a}", 3).alias(f"m{a}") for a in "xyz"), "formed", "missing")


def hydronium_slabs(spark, sf):
    return voxels.hydronium(atoms(spark, sf), 5.0, 0.0, (10.0, 10.0), 8.0, reach=3.0)


def nearest_partner(spark, sf):
    a = atoms(spark, sf)
    shell = structure.sphere(a.filter("type = 3"), (10.0, 10.0, 10.0), 5.0, 6.0)
    return partner_distances(shell, a.filter("type = 2"), 2.0).select("frame", "atom_id", R("distance").alias("distance"))


def crossing_bonds(spark, sf):
    half = bonds(atoms(spark, sf), CUTOFFS, BOX, half=True, carry=("x", "y", "z"))
    plain = half.select("frame", "type_i", "type_j", *((F.col(f"{a}_j") - F.col(f"{a}_i")).alias(f"r{a}") for a in "xyz"))
    return structure.crossing_bonds(plain, (L, L, L, 0.0, 0.0, 0.0), (L * L,) * 3).select("frame", "face", "pair", "n", R("per_area", 6).alias("per_area"))


#: xy, xz, yz of a tilted cell, more than a third of its edges.
TILT = (7.25, -3.5, 8.75)


def tilted_crossings(spark, sf):
    """Bonds across the faces of a tilted cell, by images along its vectors."""
    half = bonds(atoms(spark, sf), CUTOFFS, BOX, half=True, carry=("x", "y", "z"), tilt=TILT)
    plain = half.select("frame", "type_i", "type_j", *((F.col(f"{a}_j") - F.col(f"{a}_i")).alias(f"r{a}") for a in "xyz"))
    areas = [VOLUME / h for h in heights(BOX, TILT)]
    return structure.crossing_bonds(plain, (*BOX, *TILT), areas).select("frame", "face", "pair", "n", R("per_area", 6).alias("per_area"))


def tilted_rdf(spark, sf):
    """Pairs by distance in the tilted cell."""
    return pair_bins(atoms(spark, sf), 4.0, WIDTH, BOX, tilt=TILT)


def sheared(spark, sf):
    """The snapshots, each in a cell of its own that grows and leans with the frame."""
    f = F.col("frame")
    return atoms(spark, sf).withColumns({"lx": 20.0 + f * 0.25, "ly": 21.0 - f * 0.125, "lz": F.lit(22.0), "xy": f * 0.375, "xz": F.lit(-1.5), "yz": 2.0 - f * 0.25})


def reciprocal_cells(spark, sf):
    found = dist.reciprocal_cells(sheared(spark, sf), 1.0, 0.125)
    return found.select("type_i", "type_j", "bin", "n", R("s", 4).alias("s"))


def silanols(spark, sf):
    return structure.silanol(atoms(spark, sf), BOX, 2.6, 2.2, pad=0.5, surface=6.0)


def silanols_of_set(spark, sf):
    """Silanols on silicons of a set that is supplied: those in the lower half along y."""
    a = atoms(spark, sf)
    return structure.silanol(a, BOX, 2.6, 2.2, pad=0.5, silicons=a.filter("type = 1 and y < 10").select("frame", "atom_id"))


def silanol_counts(spark, sf):
    return silanols(spark, sf).groupBy("frame").agg(F.count("*").alias("silanols"))


SILANOL = f"""{PR}, ext as (select frame, min(x) as lo, max(x) as hi from atoms where type = 1 group by frame),
  o as (select frame, i, x_i, count(*) filter (type_j = 1 and r <= 2.6e0) as si, count(*) filter (type_j = 3 and r <= 2.2e0) as h, max(x_j) filter (type_j = 1 and r <= 2.6e0) as sx from pr where type_i = 2 group by all),
  sil as (select o.frame, count(*) as silanols from o join ext using (frame) where si = 1 and h >= 1 and x_i between lo - 0.5e0 and hi + 0.5e0 and (sx <= lo + 6e0 or sx >= hi - 6e0) group by o.frame)"""


def count_stats(spark, sf):
    s = structure.count_statistics(silanol_counts(spark, sf), "silanols")
    return s.select("n", *(R(c, 4).alias(c) for c in ("mean", "median", "variance", "deviation", "sem")), "least", "most", "span", *(R(c, 4).alias(c) for c in ("q1", "q3", "iqr")))


def bbox_subset(spark, sf):
    return structure.subset(atoms(spark, sf), (2.0, 3.0, 4.0), (9.5, 12.0, 18.0)).select("frame", "atom_id", R("x").alias("x"), R("y").alias("y"), R("z").alias("z"))


def region_density(spark, sf):
    return structure.region_density(atoms(spark, sf), mass(), (2.0, 3.0, 4.0), (9.5, 12.0, 18.0)).select("frame", "atoms", R("density").alias("density"))


def mirror(spark, sf):
    return structure.mirror(atoms(spark, sf), "z", [(0.0, L)] * 3, velocities=False).select("frame", "atom_id", *(R(a).alias(a) for a in "xyz"))


def rotate(spark, sf):
    return structure.rotate_y(atoms(spark, sf), [(0.0, L)] * 3, velocities=False).select("frame", "atom_id", *(R(a).alias(a) for a in "xyz"))


def shortest_distances(spark, sf):
    return structure.shortest(near(spark, sf, 3.0, half=True), 5).select("type_i", "type_j", "rank", R("r").alias("r"))


def coordination_zero(spark, sf):
    a = atoms(spark, sf)
    return structure.coordination(a, pairs(a, 1.2, BOX)).groupBy("frame").agg(F.count_if(F.col("n") == 0).alias("free"), F.max("n").cast("bigint").alias("most"))


def nearest_three(spark, sf):
    return nearest(near(spark, sf, 3.0, most=3), 3).groupBy("rank").agg(F.count("*").alias("n"), R(F.avg("r"), 4).alias("r"))


QUERIES = {f.__name__: f for f in (
    pair_counts, rdf_partial, coordination_cn, rdf_total_neutron, concentrations, first_concentrations, neutron_sq, water_dipoles_without_first, explicit_images, bond_angles, angle_sweep, sq_from_gr, xray_sq, debye_sq, reciprocal_sq, reciprocal_cells, knn2_dipole, hydronium_slabs,
    nearest_partner, crossing_bonds, tilted_crossings, tilted_rdf, silanol_counts, silanols_of_set, count_stats, bbox_subset, region_density, mirror, rotate, shortest_distances, coordination_zero, nearest_three,
)}

#: The nearest image of each pair in the tilted cell: along c first, then b, then a, which is right up to half the least height.
TILTED = f"""{AT}, t0 as (select a.frame, a.atom_id as i, b.atom_id as j, a.type as type_i, b.type as type_j, b.x - a.x as x, b.y - a.y as y, b.z - a.z as z from atoms a join atoms b on a.frame = b.frame and a.atom_id <> b.atom_id),
  t1 as (select *, floor(z/{LEN} + 0.5e0) as nz from t0), t2 as (select *, floor((y - nz*({TILT[2]}e0))/{LEN} + 0.5e0) as ny from t1), t3 as (select *, floor((x - nz*({TILT[1]}e0) - ny*({TILT[0]}e0))/{LEN} + 0.5e0) as nx from t2),
  tp as (select frame, i, j, type_i, type_j, nx, ny, nz, sqrt(pow(x - nz*({TILT[1]}e0) - ny*({TILT[0]}e0) - nx*{LEN}, 2) + pow(y - nz*({TILT[2]}e0) - ny*{LEN}, 2) + pow(z - nz*{LEN}, 2)) as r from t3)"""

ORACLE_SQL = {
    "reciprocal_cells": f"""with {AT}, cl as (select distinct frame, 20e0 + frame*0.25e0 as lx, 21e0 - frame*0.125e0 as ly, 22e0 as lz, frame*0.375e0 as xy, -1.5e0 as xz, 2e0 - frame*0.25e0 as yz from atoms),
        pt as (select h, k, l from range(0, 12) a(h), range(-12, 13) b(k), range(-12, 13) c(l) where h > 0 or k > 0 or (k = 0 and l > 0)),
        p1 as (select *, {2 * math.pi!r}*h/lx as qx from cl cross join pt), p2 as (select *, ({2 * math.pi!r}*k - xy*qx)/ly as qy from p1), p3 as (select *, ({2 * math.pi!r}*l - xz*qx - yz*qy)/lz as qz from p2),
        p4 as (select *, sqrt(qx*qx + qy*qy + qz*qz) as q from p3 where sqrt(qx*qx + qy*qy + qz*qz) <= 1e0),
        w as (select p.frame, h, k, l, q, type, sum(cos(qx*x + qy*y + qz*z)) as c, sum(sin(qx*x + qy*y + qz*z)) as s, count(*) as n from p4 p join atoms a on a.frame = p.frame group by all)
        select a.type as type_i, b.type as type_j, cast(floor(a.q/0.125e0) as int) as bin, count(*) as n, round(avg((a.c*b.c + a.s*b.s)/sqrt(a.n*b.n)), 4) + 0e0 as s
        from w a join w b on a.frame = b.frame and a.h = b.h and a.k = b.k and a.l = b.l and a.type <= b.type group by 1, 2, 3""",
    "tilted_rdf": f"with {TILTED} select type_i, type_j, cast(floor(r/{WIDTH}e0) as int) as bin, count(*) as n from tp where r <= 4e0 group by all",
    "tilted_crossings": f"""with {TILTED}, cut(a, b, c) as (values {", ".join(f"({a}, {b}, {c}e0)" for (a, b), c in CUTOFFS.items())}),
        bd as (select tp.* from tp join cut on least(type_i, type_j) = cut.a and greatest(type_i, type_j) = cut.b and r < c and i < j),
        f as (select frame, type_i, type_j, 'x' as face, abs(nx) as k, {VOLUME / heights(BOX, TILT)[0]!r} as area from bd union all select frame, type_i, type_j, 'y', abs(ny), {VOLUME / heights(BOX, TILT)[1]!r} from bd
          union all select frame, type_i, type_j, 'z', abs(nz), {VOLUME / heights(BOX, TILT)[2]!r} from bd)
        select frame, face, least(type_i, type_j)::varchar || '-' || greatest(type_i, type_j)::varchar as pair, cast(sum(k) as bigint) as n, round(sum(k)/any_value(area), 6) + 0e0 as per_area from f where k > 0 group by frame, face, least(type_i, type_j), greatest(type_i, type_j)""",
    "pair_counts": f"with {HIST} select type_i, type_j, bin, n from hist",
    "rdf_partial": f"with {HIST} select type_i, type_j, bin, n, round(g, 5) + 0e0 as g, round(cn, 5) + 0e0 as cn from gr",
    "coordination_cn": f"""with {HIST} select type_i, type_j, bin, round((bin + 1)*{WIDTH}e0, 5) + 0e0 as r,
        round(n/(ideal*{4 * math.pi!r}*pow((bin + 1)*{WIDTH}e0, 2)*{WIDTH}e0), 5) + 0e0 as g, round(cn, 5) + 0e0 as cn from gr join norms using (type_i, type_j)""",
    "rdf_total_neutron": f"""with {HIST}, b(type, b) as (values {", ".join(f"({k}, {v}e0)" for k, v in LENGTHS.items())}), w as (select type, fraction, b from frac join b using (type)),
        tot as (select bin, r, sum(x.fraction*y.fraction*x.b*y.b*g)/pow((select sum(fraction*b) from w), 2) as g from gr join w x on x.type = type_i join w y on y.type = type_j group by bin, r)
        select bin, round(g, 4) + 0e0 as g, round({4 * math.pi * DENSITY!r}*r*g, 4) + 0e0 as t from tot""",
    "concentrations": f"with {HIST} select type, atoms, round(fraction, 5) + 0e0 as fraction from frac",
    "explicit_images": f"""with {AT}, im as (select k*{LEN} as s from range(-1, 2) t(k)), e as (select a.frame, sqrt(pow(b.x - a.x + p.s, 2) + pow(b.y - a.y + q.s, 2) + pow(b.z - a.z + u.s, 2)) as r
        from atoms a join atoms b on a.frame = b.frame and a.type = 1 and b.type = 3 cross join im p cross join im q cross join im u) select frame, count(*) as n, round(sum(r), 3) + 0e0 as total from e where r <= 6e0 group by frame""",
    "bond_angles": angle_sql(PLANS, 3.2, "frame"),
    "angle_sweep": angle_sql(dist.default_triplets([1, 2, 3], CUTOFFS), 3.0, "sum"),
    "sq_from_gr": f"with {SQ} select type_i, type_j, round(q, 2) + 0e0 as q, round(s, 4) + 0e0 as s from sq",
    "xray_sq": f"""with {SQ}, mean as (select q, sum(fraction*({FORM("type")})) as f from frac cross join (select distinct q from sq) group by q)
        select round(q, 2) + 0e0 as q, round(sum(sqrt(a.fraction*b.fraction)*({FORM("type_i")})*({FORM("type_j")})*s)/pow(any_value(f), 2), 4) + 0e0 as s
        from sq join frac a on a.type = type_i join frac b on b.type = type_j join mean using (q) group by q""",
    "neutron_sq": f"""with {SQ}, b(type, b) as (values {", ".join(f"({k}, {v}e0)" for k, v in LENGTHS.items())}), w as (select type, fraction, b from frac join b using (type))
        select round(q, 2) + 0e0 as q, round(sum(sqrt(x.fraction*y.fraction)*x.b*y.b*s)/pow((select sum(fraction*b) from w), 2), 3) + 0e0 as s from sq join w x on x.type = type_i join w y on y.type = type_j group by q""",
    "first_concentrations": f"with {AT}, f as (select * from atoms where frame = (select min(frame) from atoms)) select type, count(*) as atoms, round(count(*)/(select count(*) from f), 5) + 0e0 as fraction from f group by type",
    "water_dipoles_without_first": f"""with {PR}, keep as (select * from atoms where frame > (select min(frame) from atoms b where b.frame // 5 = atoms.frame // 5)), k as (select *, row_number() over (partition by frame, i order by r, j) as rank from pr where type_i = 2 and type_j = 3 and r < 3e0),
        w as (select frame, i, count(*) as n from k where rank <= 2 group by all) select a.frame, count(*) filter (n = 2) as formed, count(*) filter (n is null or n <> 2) as missing from keep a left join w on a.frame = w.frame and a.atom_id = w.i where a.type = 2 group by a.frame""",
    "debye_sq": f"""with {HIST} select type_i, type_j, round(q, 2) + 0e0 as q, round(case when type_i = type_j then 1e0 else 0e0 end + sum(n*sin(q*r)/(q*r))/sqrt(a.atoms*b.atoms), 3) + 0e0 as s
        from gr join frac a on a.type = type_i join frac b on b.type = type_j cross join (select k*0.25e0 as q from range(1, 21) t(k)) group by type_i, type_j, q, a.atoms, b.atoms""",
    "reciprocal_sq": f"""with {AT}, m as (select k from range(-3, 4) t(k)), p as (select a.k as h, b.k as k, c.k as l, a.k*a.k + b.k*b.k + c.k*c.k as q2 from m a, m b, m c),
        q as (select * from p where q2 between 1 and 9 and (h > 0 or h = 0 and (k > 0 or k = 0 and l > 0))),
        w as (select frame, type, h, k, l, q2, sum(cos({2 * math.pi / L!r}*(h*x + k*y + l*z))) as c, sum(sin({2 * math.pi / L!r}*(h*x + k*y + l*z))) as s, count(*) as n from atoms cross join q group by all)
        select a.type as type_i, b.type as type_j, cast(a.q2 as int) as q2, round(avg((a.c*b.c + a.s*b.s)/sqrt(a.n*b.n)), 4) + 0e0 as s from w a join w b on a.frame = b.frame and a.h = b.h and a.k = b.k and a.l = b.l and a.type <= b.type group by all""",
    "knn2_dipole": f"""with {PR}, k as (select *, row_number() over (partition by frame, i order by r, j) as rank from pr where type_i = 2 and type_j = 3 and r < 3e0),
        w as (select frame, i, count(*) as n, sum(dx) as x, sum(dy) as y, sum(dz) as z from k where rank <= 2 group by all)
        select a.frame, {", ".join(f"round(sum(case when n = 2 then -0.41e0*w.{c} else 0e0 end), 3) + 0e0 as m{c}" for c in "xyz")}, count(*) filter (n = 2) as formed, count(*) filter (n is null or n <> 2) as missing
        from atoms a left join w on a.frame = w.frame and a.atom_id = w.i where a.type = 2 group by a.frame""",
    "hydronium_slabs": f"""with {AT}, rod as (select *, sqrt(pow(y - 10e0, 2) + pow(z - 10e0, 2)) as d from atoms), h as (select a.frame, a.atom_id, a.x, count(*) as n from rod a join rod b on a.frame = b.frame
        and a.type = 2 and a.d <= 8e0 and b.type = 3 and b.d <= 9.3e0 and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 3e0 group by all)
        select frame, cast(floor(x/5e0) as int) as ix, count(*) as n from h where n >= 3 group by all""",
    "nearest_partner": f"""with {AT}, sh as (select *, sqrt(pow(x - 10e0, 2) + pow(y - 10e0, 2) + pow(z - 10e0, 2)) as d from atoms where type = 3)
        select a.frame, a.atom_id, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 5) + 0e0 as distance from sh a join atoms b on a.frame = b.frame and b.type = 2 where a.d > 5e0 and a.d <= 6e0 group by all""",
    "crossing_bonds": f"""with {PR}, cut(a, b, c) as (values {", ".join(f"({a}, {b}, {c}e0)" for (a, b), c in CUTOFFS.items())}),
        bd as (select p.*, x.x as x1, x.y as y1, x.z as z1, y.x as x2, y.y as y2, y.z as z2 from pr p join cut on least(type_i, type_j) = cut.a and greatest(type_i, type_j) = cut.b and r < c and i < j join atoms x on x.atom_id = i join atoms y on y.atom_id = j),
        f as (select frame, type_i, type_j, 'x' as face, abs(round(((x2 - x1) - dx)/{LEN})) as k from bd union all select frame, type_i, type_j, 'y', abs(round(((y2 - y1) - dy)/{LEN})) from bd union all select frame, type_i, type_j, 'z', abs(round(((z2 - z1) - dz)/{LEN})) from bd)
        select frame, face, least(type_i, type_j)::varchar || '-' || greatest(type_i, type_j)::varchar as pair, cast(sum(k) as bigint) as n, round(sum(k)/{L * L!r}, 6) + 0e0 as per_area from f where k > 0 group by all""",
    "silanol_counts": f"with {SILANOL} select frame, silanols from sil",
    "silanols_of_set": f"""with {PR}, ext as (select frame, min(x) as lo, max(x) as hi from atoms where type = 1 group by frame),
        o as (select frame, i, x_i, count(*) filter (type_j = 1 and r <= 2.6e0) as si, count(*) filter (type_j = 3 and r <= 2.2e0) as h, max(j) filter (type_j = 1 and r <= 2.6e0) as s from pr where type_i = 2 group by all)
        select o.frame, o.i as atom_id, o.s as silicon_id from o join ext using (frame) join atoms b on b.frame = o.frame and b.atom_id = o.s and b.y < 10 where si = 1 and h >= 1 and x_i between lo - 0.5e0 and hi + 0.5e0""",
    "count_stats": f"""with {SILANOL} select count(*) as n, round(avg(silanols), 4) + 0e0 as mean, round(quantile_cont(silanols, 0.5e0), 4) + 0e0 as median, round(var_pop(silanols), 4) + 0e0 as variance, round(stddev_pop(silanols), 4) + 0e0 as deviation,
        round(stddev_pop(silanols)/sqrt(count(*)), 4) + 0e0 as sem, min(silanols) as least, max(silanols) as most, max(silanols) - min(silanols) as span, round(quantile_cont(silanols, 0.25e0), 4) + 0e0 as q1,
        round(quantile_cont(silanols, 0.75e0), 4) + 0e0 as q3, round(quantile_cont(silanols, 0.75e0) - quantile_cont(silanols, 0.25e0), 4) + 0e0 as iqr from sil""",
    "bbox_subset": f"with {AT} select frame, atom_id, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(z, 5) + 0e0 as z from atoms where x between 2e0 and 9.5e0 and y between 3e0 and 12e0 and z between 4e0 and 18e0",
    "region_density": f"with {AT} select frame, count(*) as atoms, round(sum({MASS_SQL})/{7.5 * 9 * 14}e0*1.6605e0, 5) + 0e0 as density from atoms where x between 2e0 and 9.5e0 and y between 3e0 and 12e0 and z between 4e0 and 18e0 group by frame",
    "mirror": f"with {AT} select frame, atom_id, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round({LEN} - z, 5) + 0e0 as z from atoms",
    "rotate": f"with {AT} select frame, atom_id, round(z, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round({LEN} - x, 5) + 0e0 as z from atoms",
    "shortest_distances": f"""with {PR}, k as (select least(type_i, type_j) as type_i, greatest(type_i, type_j) as type_j, r, row_number() over (partition by least(type_i, type_j), greatest(type_i, type_j) order by r, frame, i, j) as rank from pr where i < j and r <= 3e0)
        select type_i, type_j, cast(rank as int) as rank, round(r, 5) + 0e0 as r from k where rank <= 5""",
    "coordination_zero": f"""with {PR}, c as (select a.frame, a.atom_id, count(p.j) as n from atoms a left join (select * from pr where r <= 1.2e0) p on a.frame = p.frame and a.atom_id = p.i group by all)
        select frame, count(*) filter (n = 0) as free, max(n) as most from c group by frame""",
    "nearest_three": f"""with {PR}, k as (select r, row_number() over (partition by frame, i order by r, j) as rank from pr where r <= 3e0) select cast(rank as int) as rank, count(*) as n, round(avg(r), 4) + 0e0 as r from k where rank <= 3 group by rank""",
}
