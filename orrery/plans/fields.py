"""Queries over voxels, dipole series and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands as bd
from ..operators import series, voxels
from .spatial import MASS_SQL, R, mass
from .views import BANDS_DUCK, DIPOLES, VOX, VOXEL_BOX, bands, dipoles, duck, vox

SIZE = 5.0
X, Y, Z = VOXEL_BOX
N = tuple(-int(-n // SIZE) for n in VOXEL_BOX)


def fields(spark, sf):
    return voxels.voxel_fields(vox(spark, sf), SIZE, VOXEL_BOX, mass())


ROUNDED = {"density": 4, "number_density": 4, "vcom_x": 4, "vcom_y": 4, "vcom_z": 4, "temperature": 3, "pressure": 1, "virial_pressure": 1, "avg_speed": 4, "avg_o_speed": 4}


def voxel_fields(spark, sf):
    return fields(spark, sf).select("frame", "ix", "iy", "iz", "n", *(R(c, d).alias(c) for c, d in ROUNDED.items()), "voxel_type")


def voxel_smooth(spark, sf):
    out = voxels.box_smooth(fields(spark, sf), N, ["density", "avg_o_speed"])
    return out.select("frame", "ix", "iy", "iz", R("density", 4).alias("density"), R("avg_o_speed", 4).alias("avg_o_speed"))


def heights(spark, sf):
    return voxels.surface(vox(spark, sf), SIZE, VOXEL_BOX)


def si_surface(spark, sf):
    return heights(spark, sf).select("frame", "iy", "iz", R("height").alias("height"), "ix")


def jet_tip(spark, sf):
    return voxels.jet_tip(fields(spark, sf), SIZE, 10.0).select("frame", R("tip").alias("tip"))


def crater(spark, sf):
    out = voxels.crater(heights(spark, sf), (F.col("iy") < 2) | (F.col("iz") < 2), 5.0)
    return out.select("frame", T("reference", 4).alias("reference"), R("median", 4).alias("median"), "bins", T("deepest", 4).alias("deepest"))


def crater_fit(spark, sf):
    h = heights(spark, sf)
    points = h.select("frame", F.col("height").alias("x"), ((F.col("iy") + 0.5) * SIZE).alias("y"), ((F.col("iz") + 0.5) * SIZE).alias("z"))
    return voxels.sphere_fit(points, (30.0, 30.0), residual=15.0).select("frame", R("cx", 3).alias("cx"), R("radius", 3).alias("radius"))


def first_hit(spark, sf):
    return voxels.first_hit(fields(spark, sf)).groupBy("frame", "ix").agg(F.count("*").alias("n"))


def display_range(spark, sf):
    return voxels.display_range(fields(spark, sf), "density", 2.0).select("frame", R("lo", 4).alias("lo"), R("hi", 4).alias("hi"))


def T(c, digits):
    """Rounded after a nudge, so that sums of short decimals, which often end in a tie, round alike in any order."""
    return R(F.col(c) + 1e-9, digits)


def shown(df):
    return df.select("traj_id", "step", *(T(c, d).alias(c) for c, d in (("m2", 4), ("mm", 4), ("variance", 4), ("debye2", 3), ("epsilon", 2))))


PHYSICS = {"temperature": 300.0, "volume": 27000.0}
WINDOW, BIN = 100, 20


def dipole_windowed(spark, sf):
    return shown(series.sliding(dipoles(spark, sf), WINDOW, **PHYSICS))


def dipole_cumulative(spark, sf):
    return shown(series.cumulative(dipoles(spark, sf), **PHYSICS))


def dipole_hybrid(spark, sf):
    return shown(series.hybrid(dipoles(spark, sf), WINDOW, **PHYSICS))


def dipole_binned(spark, sf):
    return shown(series.binned(dipoles(spark, sf), BIN, **PHYSICS))


def dielectric(spark, sf):
    out = series.dielectric(dipoles(spark, sf), 300.0, 27000.0)
    return out.select("traj_id", "n", *(R(c, 4).alias(c) for c in ("var_x", "var_y", "var_z", "total")), R("epsilon", 2).alias("epsilon"))


def smoothed_histogram(spark, sf):
    """Counts of the dipoles' x by whole units, for each series."""
    k = (F.floor("mx") + 20).cast("int")
    counts = dipoles(spark, sf).groupBy(F.col("traj_id").alias("label"), k.alias("k")).agg(F.count("*").cast("double").alias("y"))
    labels = counts.select("label").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(40))))
    whole = labels.join(counts, ["label", "k"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    return series.gaussian_smooth(whole, 2.0)


def gaussian_smooth(spark, sf):
    return smoothed_histogram(spark, sf).select("label", "k", R("y", 5).alias("y"))


def curve_peaks(spark, sf):
    out = series.peaks(smoothed_histogram(spark, sf), 0.5)
    return out.select("label", "k", *(R(c, 4).alias(c) for c in ("y", "prominence", "left", "right", "fwhm")))


def energies(b):
    """An energy and an occupation of each band, made of its weights."""
    return b.groupBy("step", "band").agg(((F.sum(F.col("weight") * (F.col("atom") + 1)) % 20000) / F.lit(4000.0) - 2.5).alias("energy"), ((F.sum("weight") % 5) / F.lit(2.0)).alias("occ"))


def dos_gauss(spark, sf):
    return bd.broadened(energies(bands(spark, sf)), F.col("energy"), F.lit(1.0)).select("bin", R("dos", 6).alias("dos"))


def pdos(spark, sf):
    b = bands(spark, sf)
    w = b.withColumn("region", (F.col("atom") / 32).cast("int")).withColumn("type", F.col("atom") % 3)
    return bd.projected(w, energies(b), ["region", "type"], bin_size=0.02).select("region", "type", "bin", R("dos", 5).alias("dos"))


def band_hybrid(spark, sf):
    w = bands(spark, sf).withColumn("type", F.col("atom") % 3)
    return bd.hybridisation(w).groupBy("type_i", "type_j").agg(R(F.sum("weight"), 4).alias("weight"))


def occupied_bands(spark, sf):
    e = energies(bands(spark, sf))
    return e.groupBy(bd.occupation(F.col("occ")).alias("electrons")).agg(F.count("*").alias("n"), R(F.avg(bd.relative_energy(F.col("energy"), F.lit(0.25))), 4).alias("energy"))


def participation(spark, sf):
    return bd.participation(bd.contributions(bands(spark, sf))).select("band", R("participation", 5).alias("participation"))


def contribution_sort(spark, sf):
    return bd.ranked(bd.contributions(bands(spark, sf))).select("band", "rank", "atom", R("p", 6).alias("p"))


QUERIES = {f.__name__: f for f in (
    voxel_fields, voxel_smooth, si_surface, jet_tip, crater, crater_fit, first_hit, display_range, dipole_windowed, dipole_cumulative, dipole_hybrid, dipole_binned, dielectric,
    gaussian_smooth, curve_peaks, dos_gauss, pdos, band_hybrid, occupied_bands, participation, contribution_sort,
)}

IX = lambda a, n, k: f"cast(least(floor({a}/5e0), {k - 1}) as int)"
EDGE = lambda i, n: f"least(5e0, {n}e0 - {i}*5e0)"
K, KB, BAR, G = voxels.KINETIC, voxels.BOLTZMANN, voxels.BAR, voxels.GRAM
FIELDS = f"""vox as ({duck(VOX)}), s as (select frame, {IX("x", X, N[0])} as ix, {IX("y", Y, N[1])} as iy, {IX("z", Z, N[2])} as iz, {MASS_SQL} as m, * exclude (frame) from vox),
  g as (select frame, ix, iy, iz, count(*) as n, sum(m) as m, sum(m*vx) as px, sum(m*vy) as py, sum(m*vz) as pz, sum(m*(vx*vx + vy*vy + vz*vz)) as mv2, sum(m*x) as rx, sum(m*y) as ry, sum(m*z) as rz, sum(fx) as fx, sum(fy) as fy, sum(fz) as fz,
    sum(x*fx + y*fy + z*fz) as rf, avg(sqrt(vx*vx + vy*vy + vz*vz)) as avg_speed, avg(sqrt(vx*vx + vy*vy + vz*vz)) filter (type = 2) as avg_o_speed, max(case when type = 1 then 2 else 1 end) as voxel_type from s group by all),
  f as (select *, {EDGE("ix", X)}*{EDGE("iy", Y)}*{EDGE("iz", Z)} as v, rf - (rx*fx + ry*fy + rz*fz)/m as virial from g),
  fields as (select frame, ix, iy, iz, n, m/v*{G}e0 as density, n/v as number_density, px/m as vcom_x, py/m as vcom_y, pz/m as vcom_z,
    case when n > 1 then (mv2 - (px*px + py*py + pz*pz)/m)*{K!r}/((3*n - 3)*{KB!r}) end as temperature, (mv2*{K!r} + virial)/(3*v)*{BAR!r} as pressure, virial/(3*v)*{BAR!r} as virial_pressure, avg_speed, avg_o_speed, voxel_type from f)"""
SURF = f"""{FIELDS}, surf as (select frame, iy, iz, max(x) as height from s where type = 1 group by all)"""
MOMENTS = ", ".join(f"avg(m{a}) over w as a{a}, avg(m{a}*m{a}) over w as b{a}" for a in "xyz")
EPS = series.DIELECTRIC
SHOWN = f"""select traj_id, step, round(sq + 1e-9, 4) + 0e0 as m2, round(mm + 1e-9, 4) + 0e0 as mm, round(sq - mm + 1e-9, 4) + 0e0 as variance, round((sq - mm)*{series.DEBYE**2!r} + 1e-9, 3) + 0e0 as debye2, round((sq - mm)*{EPS / (300.0 * 27000.0)!r} + 1e-9, 2) + 0e0 as epsilon
  from (select *, (bx + by_ + bz)/3 as sq, (ax*ax + ay*ay + az*az)/3 as mm from m)"""
MOMENTS = MOMENTS.replace("as by,", "as by_,")
D = f"d as ({duck(DIPOLES)})"
over = lambda frame: f"with {D}, m as (select traj_id, step, row_number() over (partition by traj_id order by step) as rn, {MOMENTS} from d window w as (partition by traj_id order by step {frame}))"
BW = f"b as ({BANDS_DUCK}), en as (select band, (sum(weight*(atom + 1)) % 20000)/4000e0 - 2.5e0 as energy, (sum(weight) % 5)/2e0 as occ from b group by band)"
KERN = lambda size: ", ".join(f"({k - len(bd.kernel(0.04, size)) // 2}, {v!r})" for k, v in enumerate(bd.kernel(0.04, size)))
CON = f"{BW}, con as (select band, atom, weight/sum(weight) over (partition by band) as p from b)"
GAUSS = ", ".join(f"({d}, {w!r})" for d, w in zip(range(-8, 9), (lambda e: [x / sum(e) for x in e])([__import__("math").exp(-0.5 * (d / 2.0) ** 2) for d in range(-8, 9)]), strict=True))
SMOOTH = f"""{D}, h as (select traj_id as label, cast(floor(mx) + 20 as int) as k, count(*) as y from d group by all), lab as (select distinct label from h), full_ as (select label, k, coalesce(y, 0) as y from lab cross join range(0, 41) t(k) left join h using (label, k)),
  ker(d, w) as (values {GAUSS}), mv as (select label, k, w, case when m >= 0 and m <= 40 then m when m < 0 then -1 - m else 81 - m end as from_ from (select label, k, w, k + d as m from full_ cross join ker)), sm as (select mv.label, mv.k, sum(w*f.y) as y from mv join full_ f on f.label = mv.label and f.k = from_ group by all)"""

ORACLE_SQL = {
    "voxel_fields": f"with {FIELDS} select frame, ix, iy, iz, n, {', '.join(f'round({c}, {d}) + 0e0 as {c}' for c, d in ROUNDED.items())}, voxel_type from fields",
    "voxel_smooth": f"""with {FIELDS}, grid as (select frame, cast(i as int) as ix, cast(j as int) as iy, cast(k as int) as iz from (select distinct frame from fields) cross join range(0, {N[0]}) a(i) cross join range(0, {N[1]}) b(j) cross join range(0, {N[2]}) c(k))
        select g.frame, g.ix, g.iy, g.iz, round(sum(f.density)/count(f.density), 4) + 0e0 as density, round(sum(f.avg_o_speed)/nullif(count(f.avg_o_speed), 0), 4) + 0e0 as avg_o_speed
        from grid g join fields f on f.frame = g.frame and abs(f.ix - g.ix) <= 3 and abs(f.iy - g.iy) <= 3 and abs(f.iz - g.iz) <= 3 group by all""",
    "si_surface": f"with {SURF} select frame, iy, iz, round(height, 5) + 0e0 as height, {IX('height', X, N[0])} as ix from surf",
    "jet_tip": f"with {FIELDS} select frame, round((max(ix) + 0.5e0)*5e0, 5) + 0e0 as tip from fields where voxel_type = 1 and avg_speed > 10e0 group by frame",
    "crater": f"""with {SURF}, p as (select frame, avg(height) filter (iy < 2 or iz < 2) as ref, quantile_cont(height, 0.5e0) as med from surf group by frame)
        select frame, round(ref + 1e-9, 4) + 0e0 as reference, round(med, 4) + 0e0 as median, count(*) filter (ref - height > 5e0) as bins, round(max(ref - height) + 1e-9, 4) + 0e0 as deepest from surf join p using (frame) group by frame, ref, med""",
    "crater_fit": f"""with {SURF}, p as (select frame, height as x, pow((iy + 0.5e0)*5e0 - 30e0, 2) + pow((iz + 0.5e0)*5e0 - 30e0, 2) as d2 from surf), l1 as (select frame, regr_slope(-(x*x + d2), x) as a, regr_intercept(-(x*x + d2), x) as c from p group by frame),
        q as (select p.* from p join l1 using (frame) where abs(sqrt(pow(x + a/2, 2) + d2) - sqrt(greatest(a*a/4 - c, 0e0))) <= 15e0), l2 as (select frame, regr_slope(-(x*x + d2), x) as a, regr_intercept(-(x*x + d2), x) as c from q group by frame)
        select frame, round(-a/2, 3) + 0e0 as cx, round(sqrt(greatest(a*a/4 - c, 0e0)), 3) + 0e0 as radius from l2""",
    "first_hit": f"with {FIELDS}, h as (select frame, iy, iz, min(ix) as ix from fields where voxel_type = 2 group by all) select frame, ix, count(*) as n from h group by all",
    "display_range": f"with {FIELDS} select frame, round(quantile_cont(density, 0.02e0), 4) + 0e0 as lo, round(quantile_cont(density, 0.98e0), 4) + 0e0 as hi from fields group by frame",
    "dipole_windowed": over(f"rows between {WINDOW - 1} preceding and current row") + SHOWN + f" where rn >= {WINDOW}",
    "dipole_cumulative": over("rows between unbounded preceding and current row") + SHOWN,
    "dipole_hybrid": over(f"rows between {WINDOW - 1} preceding and current row") + SHOWN,
    "dipole_binned": f"""with {D}, n as (select *, (row_number() over (partition by traj_id order by step) - 1)//{BIN} as bin from d), m as (select traj_id, max(step) as step, {", ".join(f"avg(m{a}) as a{a}, avg(m{a}*m{a}) as b{a}" for a in "xyz").replace("as by,", "as by_,")} from n group by traj_id, bin having count(*) = {BIN})""" + SHOWN,
    "dielectric": f"""with {D}, v as (select traj_id, count(*) as n, avg(mx*mx) - avg(mx)*avg(mx) as x, avg(my*my) - avg(my)*avg(my) as y, avg(mz*mz) - avg(mz)*avg(mz) as z from d group by traj_id)
        select traj_id, n, round(x, 4) + 0e0 as var_x, round(y, 4) + 0e0 as var_y, round(z, 4) + 0e0 as var_z, round((x + y + z)/3, 4) + 0e0 as total, round((x + y + z)/3*{EPS / (300.0 * 27000.0)!r}, 2) + 0e0 as epsilon from v""",
    "gaussian_smooth": f"with {SMOOTH} select label, cast(k as int) as k, round(y, 5) + 0e0 as y from sm",
    "curve_peaks": f"""with {SMOOTH}, t as (select *, lag(y) over w as b, lead(y) over w as a from sm window w as (partition by label order by k)), pk as (select label, k, y from t where y > b and y > a),
        base as (select p.label, p.k, p.y, (select min(s.y) from sm s where s.label = p.label and s.k <= p.k and s.k > coalesce((select max(u.k) from sm u where u.label = p.label and u.k < p.k and u.y > p.y), -1)) as bl,
          (select min(s.y) from sm s where s.label = p.label and s.k >= p.k and s.k < coalesce((select min(u.k) from sm u where u.label = p.label and u.k > p.k and u.y > p.y), 99)) as br from pk p),
        pr as (select label, k, y, y - greatest(bl, br) as prominence, y - (y - greatest(bl, br))/2 as half from base where y - greatest(bl, br) >= 0.5e0),
        seg as (select label, k, y, lead(k) over w as nk, lead(y) over w as ny from sm window w as (partition by label order by k)),
        cr as (select p.*, s.k + (half - s.y)/(s.ny - s.y) as place, s.nk <= p.k and s.y <= half and s.ny > half as rise, s.k >= p.k and s.y > half and s.ny <= half as fall from pr p join seg s on s.label = p.label and s.nk is not null)
        select label, cast(k as int) as k, round(y, 4) + 0e0 as y, round(prominence, 4) + 0e0 as prominence, round(max(place) filter (rise), 4) + 0e0 as left, round(min(place) filter (fall), 4) + 0e0 as right, round(min(place) filter (fall) - max(place) filter (rise), 4) + 0e0 as fwhm from cr where rise or fall group by label, k, y, prominence""",
    "dos_gauss": f"with {BW}, ker(d, v) as (values {KERN(0.005)}) select cast(floor(energy/0.005e0 + 0.5e0) as int) + d as bin, round(sum(v), 6) + 0e0 as dos from en cross join ker where abs(floor(energy/0.005e0 + 0.5e0) + d) <= 1000 group by 1",
    "pdos": f"""with {BW}, ker(d, v) as (values {KERN(0.02)}), sh as (select band, atom // 32 as region, atom % 3 as type, sum(weight)/any_value(t) as w from b join (select band, sum(weight) as t from b group by band having sum(weight) > 0.5e0) q using (band) group by band, atom // 32, atom % 3)
        select cast(region as int) as region, cast(type as int) as type, cast(floor(energy/0.02e0 + 0.5e0) as int) + d as bin, round(sum(w*v), 5) + 0e0 as dos from sh join en using (band) cross join ker where abs(floor(energy/0.02e0 + 0.5e0) + d) <= 1000 group by all""",
    "band_hybrid": f"""with {BW}, sh as (select band, atom % 3 as type, sum(weight)/any_value(t) as w from b join (select band, sum(weight) as t from b group by band having sum(weight) > 0.5e0) q using (band) group by band, atom % 3)
        select cast(x.type as int) as type_i, cast(y.type as int) as type_j, round(sum(x.w*y.w), 4) + 0e0 as weight from sh x join sh y using (band) group by x.type, y.type""",
    "occupied_bands": f"with {BW} select cast(case when occ > 1.5e0 and occ < 2.1e0 then 2 when occ > 0.5e0 and occ <= 1.5e0 then 1 else 0 end as int) as electrons, count(*) as n, round(avg((energy - 0.25e0)*{bd.RYDBERG}e0), 4) + 0e0 as energy from en group by 1",
    "participation": f"with {CON} select band, round(1/sum(p*p), 5) + 0e0 as participation from con group by band",
    "contribution_sort": f"with {CON} select band, cast(row_number() over (partition by band order by p desc, atom) as int) as rank, atom, round(p, 6) + 0e0 as p from con",
}
