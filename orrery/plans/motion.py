"""Queries over moving atoms: lags, spectra, survival."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import dynamics
from ..operators.neighbors import nearest, pairs
from .spatial import R
from .views import FRAMES, TRAJ, TRAJ_BOX, duck, traj

LENGTH, STEP, DT, B = 8, 2, 0.5, TRAJ_BOX
LAST = FRAMES - LENGTH
CHARGE = {1: 2.4, 2: -1.2, 3: 0.6}

T = f"traj as ({duck(TRAJ)})"
LAG = f"""{T}, lags as (select a.type, b.frame - a.frame as lag, a.atom_id, a.frame as ref, b.vx*a.vx + b.vy*a.vy + b.vz*a.vz as vv, a.vx*a.vx + a.vy*a.vy + a.vz*a.vz as v0,
  pow(b.x - a.x - 20e0*floor((b.x - a.x)/20e0 + 0.5e0), 2) + pow(b.y - a.y - 20e0*floor((b.y - a.y)/20e0 + 0.5e0), 2) + pow(b.z - a.z - 20e0*floor((b.z - a.z)/20e0 + 0.5e0), 2) as d2
  from traj a join traj b using (atom_id) where a.frame % {STEP} = 0 and a.frame <= {LAST} and b.frame - a.frame between 0 and {LENGTH - 1})"""
C = f"{LAG}, c as (select type, lag, sum(vv)/sum(v0) as c from lags group by all)"


def curve(spark, sf):
    return dynamics.msd(traj(spark, sf), (B, B, B), LENGTH, STEP, FRAMES)


def msd(spark, sf):
    return curve(spark, sf).select("type", "lag", "n", R("msd", 4).alias("msd"))


def diffusion(spark, sf):
    return dynamics.diffusion(curve(spark, sf), DT).select("type", R("d", 2).alias("d"))


def msd_total(spark, sf):
    counts = traj(spark, sf).filter("frame = 0").groupBy("type").agg(F.count("*").alias("atoms"))
    return dynamics.weighted_total(curve(spark, sf), counts, "lag", "msd").select("lag", R("msd", 4).alias("msd"))


def vacf(spark, sf):
    return dynamics.vacf(traj(spark, sf), LENGTH, STEP, FRAMES).select("type", "lag", R("c", 5).alias("c"))


def vdos_cosine(spark, sf):
    c = dynamics.vacf(traj(spark, sf), LENGTH, STEP, FRAMES)
    return dynamics.cosine_spectrum(c, LENGTH, DT, 0.02, 50).select("type", "k", R("g", 5).alias("g"))


def current_corr(spark, sf):
    charge = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in CHARGE.items()))
    return dynamics.current_correlation(traj(spark, sf), charge, LENGTH, STEP, FRAMES).select("lag", R("c", 5).alias("c"))


def msd_breathing(spark, sf):
    """Displacements in a box whose edges change from frame to frame."""
    own = traj(spark, sf).withColumn("lx", F.lit(B) - F.col("frame") * 0.125).withColumn("ly", F.lit(B) + F.col("frame") * 0.0625)
    return dynamics.msd(own, ("lx", "ly", B), LENGTH, STEP, FRAMES).select("type", "lag", "n", R("msd", 4).alias("msd"))


def rot_corr(spark, sf):
    """Axes of the molecules that an oxygen and its two nearest hydrogens make."""
    near = pairs(traj(spark, sf), 3.0, (B, B, B), center=F.col("type") == 2, wing=F.col("type") == 3, most=2)
    axes = dynamics.molecule_axes(nearest(near, 2))
    return dynamics.rotational(axes, LENGTH, STEP, FRAMES).select("axis", "lag", R("c1", 4).alias("c1"), R("c2", 4).alias("c2"))


def pair_survival(spark, sf):
    found = dynamics.pair_survival(traj(spark, sf), 2.5, (B, B, B), LENGTH, STEP, FRAMES, F.col("type") == 2, F.col("type") == 3)
    return found.select("lag", "alive", R("s", 5).alias("s"))


def welch_power(spark, sf):
    return dynamics.welch_power(traj(spark, sf), LENGTH, STEP).select("type", "k", R("power", 3).alias("power"))


def sqw(spark, sf):
    points = [(1, 0, 0), (1, 1, 0), (2, 0, 1)]
    return dynamics.dynamic_structure(traj(spark, sf), B, points, LENGTH, FRAMES, DT, 10, 0.3).select("h", "k", "l", "m", R("s", 4).alias("s"))


QUERIES = {f.__name__: f for f in (msd, msd_breathing, diffusion, msd_total, vacf, vdos_cosine, current_corr, rot_corr, pair_survival, welch_power, sqw)}

NEAR = f"""{T}, pr as (select *, sqrt(dx*dx + dy*dy + dz*dz) as r from (select a.frame, a.atom_id as i, b.atom_id as j, b.x - a.x - 20e0*floor((b.x - a.x)/20e0 + 0.5e0) as dx,
  b.y - a.y - 20e0*floor((b.y - a.y)/20e0 + 0.5e0) as dy, b.z - a.z - 20e0*floor((b.z - a.z)/20e0 + 0.5e0) as dz from traj a join traj b on a.frame = b.frame and a.type = 2 and b.type = 3) d)"""
HANN = f"(select k, (0.5e0 - 0.5e0*cos(2*pi()*k/{LENGTH - 1}e0)) as w from range(0, {LENGTH}) t(k))"

BREATH = lambda d, size: f"pow(({d}) - ({size})*round_even(({d})/({size}), 0), 2)"

ORACLE_SQL = {
    "msd_breathing": f"""with {T} select a.type, cast(b.frame - a.frame as int) as lag, count(*) as n, round(avg({BREATH("b.x - a.x", f"{B}e0 - b.frame*0.125e0")} + {BREATH("b.y - a.y", f"{B}e0 + b.frame*0.0625e0")} + {BREATH("b.z - a.z", f"{B}e0")}), 4) + 0e0 as msd
        from traj a join traj b on a.atom_id = b.atom_id and a.frame % {STEP} = 0 and a.frame <= {FRAMES - LENGTH} and b.frame - a.frame between 0 and {LENGTH - 1} group by a.type, b.frame - a.frame""",
    "msd": f"with {LAG} select type, cast(lag as int) as lag, count(*) as n, round(avg(d2), 4) + 0e0 as msd from lags group by all",
    "diffusion": f"with {LAG}, m as (select type, lag, avg(d2) as msd from lags group by all) select type, round(regr_slope(msd, lag*{DT}e0)/6e0*1e4, 2) + 0e0 as d from m where lag >= {LENGTH // 2} group by type",
    "msd_total": f"""with {LAG}, m as (select type, lag, avg(d2) as msd from lags group by all), n as (select type, count(*) as n from traj where frame = 0 group by type)
        select cast(lag as int) as lag, round(sum(msd*n)/sum(n), 4) + 0e0 as msd from m join n using (type) group by lag""",
    "vacf": f"with {C} select type, cast(lag as int) as lag, round(c, 5) + 0e0 as c from c",
    "vdos_cosine": f"""with {C} select type, cast(k as int) as k, round(sum(c*cos({math.pi / (2 * LENGTH)!r}*lag)*cos({2 * math.pi!r}*k*0.02e0*lag*{DT}e0)*{DT}e0), 5) + 0e0 as g from c cross join range(0, 50) t(k) group by type, k""",
    "current_corr": f"""with {T}, j as (select frame, {", ".join(f"sum((case type when 1 then 2.4e0 when 2 then -1.2e0 else 0.6e0 end)*v{a}) as j{a}" for a in "xyz")} from traj group by frame)
        select cast(b.frame - a.frame as int) as lag, round(sum(a.jx*b.jx + a.jy*b.jy + a.jz*b.jz)/sum(a.jx*a.jx + a.jy*a.jy + a.jz*a.jz), 5) + 0e0 as c from j a join j b
        on a.frame % {STEP} = 0 and a.frame <= {LAST} and b.frame - a.frame between 0 and {LENGTH - 1} group by 1""",
    "rot_corr": f"""with {NEAR}, k as (select *, row_number() over (partition by frame, i order by r, j) as rank from pr where r <= 3e0), two as (select frame, i, count(*) as n, {", ".join(f"arg_min(d{a}, j) as f{a}, arg_max(d{a}, j) as l{a}" for a in "xyz")} from k where rank <= 2 group by all),
        ax as (select frame, i, 'e1' as axis, fx as x, fy as y, fz as z from two where n = 2 union all select frame, i, e, lx - fx, ly - fy, lz - fz from two cross join (values ('e2'), ('e3')) v(e) where n = 2),
        u as (select frame, i, axis, x/sqrt(x*x + y*y + z*z) as x, y/sqrt(x*x + y*y + z*z) as y, z/sqrt(x*x + y*y + z*z) as z from ax), g as (select a.axis, b.frame - a.frame as lag, a.x*b.x + a.y*b.y + a.z*b.z as c from u a join u b using (i, axis)
        where a.frame % {STEP} = 0 and a.frame <= {LAST} and b.frame - a.frame between 0 and {LENGTH - 1}) select axis, cast(lag as int) as lag, round(avg(c), 4) + 0e0 as c1, round(avg((3*c*c - 1)/2), 4) + 0e0 as c2 from g group by axis, lag""",
    "pair_survival": f"""with {NEAR}, p as (select frame, i, j from pr where r <= 2.5e0), s as (select a.i, a.j, a.frame as ref, b.frame - a.frame as lag from p a join p b using (i, j) where a.frame % {STEP} = 0 and a.frame <= {LAST} and b.frame - a.frame between 0 and {LENGTH - 1}),
        q as (select *, row_number() over (partition by i, j, ref order by lag) - 1 as run from s), t as (select lag, count(*) as alive from q where run = lag group by lag) select cast(lag as int) as lag, alive, round(alive/(select alive from t where lag = 0), 5) + 0e0 as s from t""",
    "welch_power": f"""with {T}, h as (select k, w/sqrt((select avg(w*w) from {HANN})) as w from {HANN}), seg as (select s from range(0, {FRAMES - LENGTH + 1}, {STEP}) t(s)),
        f as (select type, atom_id, s, q, {", ".join(f"sum(v{a}*w*cos({2 * math.pi / LENGTH!r}*q*h.k)) as c{a}, sum(v{a}*w*sin({2 * math.pi / LENGTH!r}*q*h.k)) as s{a}" for a in "xyz")} from traj join seg on frame - s between 0 and {LENGTH - 1} join h on h.k = frame - s cross join range(0, {LENGTH // 2 + 1}) g(q) group by all)
        select type, cast(q as int) as k, round(sum(cx*cx + sx*sx + cy*cy + sy*sy + cz*cz + sz*sz)/(select count(*) from seg), 3) + 0e0 as power from f group by type, q""",
    "sqw": f"""with {T}, pt(h, k, l) as (values (1, 0, 0), (1, 1, 0), (2, 0, 1)), w as (select frame, h, k, l, sum(cos({2 * math.pi / B!r}*(h*x + k*y + l*z))) as c, sum(sin({2 * math.pi / B!r}*(h*x + k*y + l*z))) as s, count(*) as n from traj cross join pt group by all),
        f as (select a.h, a.k, a.l, b.frame - a.frame as lag, avg((a.c*b.c + a.s*b.s)/b.n) as f from w a join w b on a.h = b.h and a.k = b.k and a.l = b.l and a.frame <= {FRAMES - LENGTH} and b.frame - a.frame between 0 and {LENGTH - 1} group by all)
        select h, k, l, cast(m as int) as m, round(sum(case when lag = 0 then 1e0 else 2e0 end*cos({math.pi / (2 * LENGTH)!r}*lag)*f*cos(m*0.3e0*lag*{DT}e0)*{DT}e0/{2 * math.pi!r}), 4) + 0e0 as s from f cross join range(0, 10) t(m) group by h, k, l, m""",
}
