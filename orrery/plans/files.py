"""Queries by way of files, logs and streams that Spark makes of the given tables, and checks of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..operators.neighbors import pairs
from ..sources import dumps, texts
from ..sources.shared import scratch
from ..streaming import jobs
from .fields import BIN, FIELDS, ROUNDED, SIZE, T
from .fields import ORACLE_SQL as FIELD_SQL
from .spatial import AT, BOX, PR, R, mass
from .views import ATOM_BOX, DIPOLES, VOXEL_BOX, atoms, dipoles, duck, vox


def dump_roundtrip(spark, sf):
    """The snapshots written as a dump and read back."""
    own, path = atoms(spark, sf), scratch(spark)
    frames = own.select("frame").distinct().select("frame", (F.col("frame") * 10).alias("timestep"), *(F.lit(v).alias(f"{a}{e}") for a in "xyz" for e, v in (("lo", 0.0), ("hi", ATOM_BOX))))
    dumps.frame_text(own, frames, ("atom_id", "type", "x", "y", "z")).select("value").write.text(path)
    _, back = dumps.read_dump(spark, path)
    return back.select((F.col("timestep") / 10).cast("int").alias("frame"), "atom_id", "type", R("x").alias("x"), R("y").alias("y"), R("z").alias("z"))


def log_sections(spark, sf):
    """Each series told as a log with a new section every 50 samples, and read again."""
    rows = dipoles(spark, sf).withColumn("rn", F.floor(F.col("step") / 16).cast("int"))
    part, at = F.floor(F.col("rn") / 50), F.col("rn") % 50
    body = rows.select(F.col("traj_id").alias("path"), (part * 100 + at + 1).alias("n"), F.concat_ws(" ", F.lit(" "), F.col("step").cast("string"), F.col("mx").cast("string")).alias("value"))
    ends = rows.select(F.col("traj_id").alias("path"), part.alias("part")).distinct()
    edge = lambda n, text: ends.select("path", (F.col("part") * 100 + n).alias("n"), F.lit(text).alias("value"))
    found = texts.log_sections(body.unionByName(edge(0, "Step Mx")).unionByName(edge(98, "Loop time of 1")).unionByName(edge(99, "12 13")))
    return found.groupBy("path", "section").agg(F.count("*").alias("n"), R(F.avg(F.element_at("w", 2)), 4).alias("mx"))


def stream_bins(spark, sf):
    """Full bins of each series by a stream with state."""
    source, out, mark = (scratch(spark) for _ in range(3))
    dipoles(spark, sf).repartition("traj_id").sortWithinPartitions("traj_id", "step").write.parquet(source)
    stream = spark.readStream.schema(jobs.SAMPLE).parquet(source)
    jobs.running_bins(stream, BIN).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("traj_id", "step", *(T(c, d).alias(c) for c, d in (("m2", 4), ("mm", 4), ("variance", 4), ("debye2", 3))))


def stream_voxels(spark, sf):
    """Voxel fields of frames that arrive in two batches."""
    source, out, mark = (scratch(spark) for _ in range(3))
    own = vox(spark, sf)
    for some in ("frame < 4", "frame >= 4"):
        own.filter(some).write.mode("append").parquet(source)
        jobs.stream_voxels(spark, source, out, mark, own.schema, SIZE, VOXEL_BOX, mass()).awaitTermination()
    return spark.read.parquet(out).select("frame", "ix", "iy", "iz", "n", R("density", ROUNDED["density"]).alias("density"), "voxel_type")


def frame_summary(spark, sf):
    return checks.frame_summary(atoms(spark, sf)).select("frames", "least", "most", R("mean", 3).alias("mean"))


def composition_formula(spark, sf):
    return checks.formula(dumps.with_elements(atoms(spark, sf), "1=Si,2=O,3=H"), keys=("frame",))


def merge_checks(spark, sf):
    """The series' samples as frames of trajectories, and the series as parts of which they were merged."""
    own = dipoles(spark, sf)
    parts = own.groupBy(F.concat(F.lit("part"), F.col("traj_id").cast("string")).alias("name")).agg(F.count("*").alias("frames"))
    return checks.merge_checks(parts, own.select("traj_id", F.col("step").alias("frame"), (F.col("step") * 5).alias("timestep")), 16)


def hbond_profile(spark, sf):
    near = pairs(atoms(spark, sf), 3.5, BOX, center=F.col("type") == 3, wing=F.col("type") == 2)
    return checks.nth_profile(near, 2, 1.8, 3.2).select(F.coalesce("frame", F.lit(-1)).alias("frame"), "n", R("mean", 4).alias("mean"), R("deviation", 4).alias("deviation"))


def hbond_angles(spark, sf):
    near = pairs(atoms(spark, sf), 4.0, BOX, center=F.col("type") == 2, wing=F.col("type") == 3)
    return checks.ranked_angles(near, 1, 2, 18).select("bin", "n", R("p").alias("p"))


QUERIES = {f.__name__: f for f in (dump_roundtrip, log_sections, stream_bins, stream_voxels, frame_summary, composition_formula, merge_checks, hbond_profile, hbond_angles)}

ORACLE_SQL = {
    "dump_roundtrip": f"with {AT} select frame, atom_id, type, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(z, 5) + 0e0 as z from atoms",
    "log_sections": f"with d as ({duck(DIPOLES)}) select traj_id as path, row_number() over (partition by traj_id order by part) as section, n, mx from (select traj_id, (step // 16) // 50 as part, count(*) as n, round(avg(mx), 4) + 0e0 as mx from d group by all)",
    "stream_bins": f"select traj_id, step, m2, mm, variance, debye2 from ({FIELD_SQL['dipole_binned']})",
    "stream_voxels": f"with {FIELDS} select frame, ix, iy, iz, n, round(density, 4) + 0e0 as density, voxel_type from fields",
    "frame_summary": f"with {AT}, c as (select frame, count(*) as n from atoms group by frame) select count(*) as frames, min(n) as least, max(n) as most, round(avg(n), 3) + 0e0 as mean from c",
    "composition_formula": f"""with {AT}, c as (select frame, case type when 1 then 'Si' when 2 then 'O' else 'H' end as e, count(*) as n from atoms group by all) select frame, string_agg(e || n::varchar, ' ' order by e) as formula from c group by frame""",
    "merge_checks": f"""with d as ({duck(DIPOLES)}), t as (select count(distinct traj_id) = 16 as a, count(*) = (select count(*) from events) as b from d), s as (select count(*) filter (step*5 <= prev) = 0 as c from (select step, lag(step*5) over (partition by traj_id order by step) as prev from d))
        select 'count' as "check", a as ok from t union all select 'not_empty', true union all select 'names', true union all select 'merged_count', b from t union all select 'rising', c from s""",
    "hbond_profile": f"""with {PR}, k as (select frame, r, row_number() over (partition by frame, i order by r, j) as rank from pr where type_i = 3 and type_j = 2 and r <= 3.5e0)
        select coalesce(frame, -1) as frame, count(*) as n, round(avg(r), 4) + 0e0 as mean, round(stddev_pop(r), 4) + 0e0 as deviation from k where rank = 2 and r > 1.8e0 and r < 3.2e0 group by rollup (frame)""",
    "hbond_angles": f"""with {PR}, k as (select *, row_number() over (partition by frame, i order by r, j) as rank from pr where type_i = 2 and type_j = 3 and r <= 4e0),
        t as (select degrees(acos(greatest(least((a.dx*b.dx + a.dy*b.dy + a.dz*b.dz)/(a.r*b.r), 1e0), -1e0))) as theta from k a join k b on a.frame = b.frame and a.i = b.i and a.rank = 1 and b.rank = 2)
        select cast(least(floor(theta/10e0), 17) as int) as bin, count(*) as n, round(count(*)/(select count(*) from t), 5) + 0e0 as p from t group by 1""",
}
