"""Trajectories, series and bands as views of the given tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Edges of the snapshots' and of the moving atoms' cubic boxes, and of the voxel box.
ATOM_BOX, TRAJ_BOX, VOXEL_BOX = 20.024, 20.0, (50.021, 60.013, 60.017)
FRAMES = 25

ATOMS = """select cast(floor(o_orderkey/500e0) as int) as frame, o_orderkey as atom_id, cast(1 + (o_orderkey*17 + o_custkey) % 3 as int) as type,
  cast((o_orderkey * 7919) % 20011 as double)/1000e0 as x, cast((o_orderkey * 104729) % 20021 as double)/1000e0 as y,
  cast((o_custkey * 15485863 + o_orderkey * 31) % 20023 as double)/1000e0 as z from {orders}"""

TRAJ = """select frame, atom_id, type, ux-20e0*floor(ux/20e0) as x, uy-20e0*floor(uy/20e0) as y, uz-20e0*floor(uz/20e0) as z, vx, vy, vz
from (select n_nationkey as frame, c_custkey as atom_id, cast(1 + c_custkey % 3 as int) as type,
  cast((c_custkey*7919)%20011 as double)/1000e0 + n_nationkey*cast((c_custkey*31)%401-200 as double)/1000e0 as ux,
  cast((c_custkey*104729)%20021 as double)/1000e0 + n_nationkey*cast((c_custkey*37)%401-200 as double)/1000e0 as uy,
  cast((c_custkey*1299709)%20023 as double)/1000e0 + n_nationkey*cast((c_custkey*41)%401-200 as double)/1000e0 as uz,
  cast((c_custkey*31+n_nationkey*17)%401-200 as double)/100e0 as vx, cast((c_custkey*37+n_nationkey*19)%401-200 as double)/100e0 as vy,
  cast((c_custkey*41+n_nationkey*23)%401-200 as double)/100e0 as vz from {customer} cross join {nation}) u"""

DIPOLES = """select event_id % 16 as traj_id, event_id as step, cast((event_id*7919)%2003-1001 as double)/100e0 as mx,
  cast((event_id*104729)%2011-1005 as double)/100e0 as my, value/10e0 as mz from {events}"""

VOX = """select l_linenumber as frame, l_orderkey*10+l_linenumber as atom_id, cast(1+l_partkey%3 as int) as type,
  cast((l_orderkey*7919+l_linenumber)%50021 as double)/1000e0 as x, cast((l_orderkey*104729)%60013 as double)/1000e0 as y,
  cast((l_orderkey*1299709)%60017 as double)/1000e0 as z,
  cast(l_quantity as double)-25e0 as vx, cast(l_discount as double)*100e0-5e0 as vy, cast(l_tax as double)*100e0-4e0 as vz, cast(l_tax as double) as fx, cast(l_discount as double) as fy, -cast(l_tax as double) as fz
from {lineitem}"""

BANDS = "select 0 as step, vec_id as band, pos as atom, cast(floor(abs(e)*1000e0) as int) as weight from (select vec_id, posexplode(embedding) as (pos, e) from {embeddings})"
BANDS_DUCK = "select 0 as step, vec_id as band, cast(i-1 as int) as atom, cast(floor(abs(embedding[i]::double)*1000e0) as int) as weight from (select vec_id, embedding, unnest(range(1, len(embedding)+1)) i from embeddings) t"

RESULTS = """select cast(doc_id as string) as student, requirement, case when value = 1 then 'MET' when value = 0 then 'NOT_MET' else 'UNCERTAIN' end as status
from (select d.doc_id, 'quality' as requirement, l.quality as value from {documents} d left join {labels} l on d.doc_id = l.doc_id
  union all select d.doc_id, 'toxic' as requirement, l.toxic as value from {documents} d left join {labels} l on d.doc_id = l.doc_id) r"""

FILES = """select concat(split_part(split_part(url, '://', 2), '/', 1), '/', split_part(split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1), '/', 2), '/', cast(page_id as string)) as path,
  cast(length(html) as bigint) as size_bytes from {pages}"""


def read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view over the tables that its text names in braces."""
    import re

    return spark.sql(text, **read(spark, sf_dir, *sorted(set(re.findall(r"\{(\w+)\}", text)))))


def duck(text: str) -> str:
    """The same text for DuckDB."""
    return text.replace("{", "").replace("}", "").replace(" as string)", " as varchar)")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ATOMS)


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRAJ)


def dipoles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DIPOLES)


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VOX)


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BANDS)
