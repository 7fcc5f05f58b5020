"""Readers, writers and streams on files made here."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.plans.views import ATOM_BOX, atoms
from orrery.sources import dumps, texts
from orrery.sources.lines import carried, lines
from orrery.streaming import jobs

DUMP = """ITEM: TIMESTEP
0
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp ff
0.0 10.0
-1.0 9.0
0 5e0
ITEM: ATOMS id type element x y z \n1 1 Si 0.5 1 2\n2 2 O 1.5 1 2
ITEM: TIMESTEP
100
ITEM: NUMBER OF ATOMS
1
ITEM: BOX BOUNDS xy xz yz pp pp pp
-1.0 12.0 2.0
0.0 10.0 -1.0
0.0 10.0 0.0
ITEM: ATOMS id type element x y z
2 2 O 1.5 1 2
ITEM: TIMESTEP
200
ITEM: NUMBER OF ATOMS
1
ITEM: BOX BOUNDS abc origin ff pp pp
10 0 0 -1
1 9 0 -2
0 2 8 -3
ITEM: ATOMS id type x element y z
7 3 1 H 2 3
ITEM: TIMESTEP
300
ITEM: NUMBER OF ATOMS
5
ITEM: BOX BOUNDS pp pp pp
0 1
0 1
0 1
ITEM: ATOMS id type element x y z
1 1 Si 0 0 0
"""


@pytest.fixture
def path(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_dump(spark, path):
    frames, rows = dumps.read_dump(spark, path("a.trj", DUMP), ("atom_id", "element", "x"))
    f = {r["timestep"]: r for r in frames.collect()}
    assert sorted(f) == [0, 100, 200]  # the last frame is cut short
    assert (f[0]["ylo"], f[0]["zhi"], f[0]["xy"], f[0]["pbc"]) == (-1.0, 5.0, 0.0, [True, True, False])
    assert (f[100]["xlo"], f[100]["xhi"], f[100]["xy"], f[100]["xz"]) == (0.0, 10.0, 2.0, -1.0)
    assert (f[200]["xlo"], f[200]["xhi"], f[200]["yhi"], f[200]["xy"], f[200]["yz"]) == (-1.0, 9.0, 7.0, 1.0, 2.0)
    assert {(r["timestep"], r["atom_id"], r["element"], r["x"]) for r in rows.collect()} == {(0, 1, "Si", 0.5), (0, 2, "O", 1.5), (100, 2, "O", 1.5), (200, 7, "H", 1.0)}
    assert dumps.validated(frames, rows).count() == 0
    some = dumps.read_dump(spark, path("a.trj", DUMP), where=F.col("timestep").between(100, 150))
    assert some[1].count() == 1


def test_missing_column_is_an_error(spark, path):
    with pytest.raises(Exception, match="no column vx"):
        dumps.read_dump(spark, path("a.trj", DUMP), ("atom_id", "vx"))[1].collect()


def test_round_trip(spark, tmp_path, sf_dir):
    own = atoms(spark, sf_dir).filter("frame < 2")
    frames = own.select("frame").distinct().select("frame", (F.col("frame") * 10).alias("timestep"), *(F.lit(v).alias(f"{a}{e}") for a in "xyz" for e, v in (("lo", 0.0), ("hi", ATOM_BOX))))
    dumps.frame_text(own, frames, ("atom_id", "type", "x", "y", "z")).select("value").write.text(str(tmp_path / "out"))
    f, back = dumps.read_dump(spark, str(tmp_path / "out"))
    same = back.select((F.col("timestep") / 10).cast("int").alias("frame"), "atom_id", "type", "x", "y", "z")
    assert f.count() == 2 and same.exceptAll(own.select(same.columns)).count() == 0 and same.count() == own.count()


def test_frame_files_and_names(spark, tmp_path):
    for n in (1000, 200):
        (tmp_path / f"dump.{n}.trj").write_text("ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ATOMS id type x y z\n%d 1 0 0 0\n" % (n, n))
    rows = dumps.read_frame_files(spark, str(tmp_path), ("atom_id", "type", "x", "y", "z")).withColumn("n", dumps.embedded_number("path"))
    assert [r["n"] for r in rows.orderBy("n").collect()] == [200, 1000]
    names = spark.createDataFrame([("d7/dump.100.trj",), ("d7/dump.20.trj",)], "path string")
    assert dumps.wildcard(names) == ("d7/dump.*.trj", 1)
    with pytest.raises(ValueError, match="number"):
        dumps.wildcard(spark.createDataFrame([("a.1",), ("b.1",)], "path string"))


def test_xyz(spark, path):
    text = "2\n10 10 10 90 90 90\nSi 0 0 0\nO 1 1 1\n2\n10 10 10 90 90 90\nSi 0 0 1\nO 1 1 2\n"
    frames, rows = dumps.read_any(spark, path("a.xyz", text))
    assert frames.count() == 2 and rows.count() == 4 and frames.first()["lattice"][:3] == [10.0] * 3
    frames, rows = dumps.read_xyz(spark, path("b.xyz", "1\nAtoms. Timestep: 50\n1 0 0 0\n1\nAtoms. Timestep: 60\n"), box=(1, 2, 3))
    assert [(r["timestep"], r["lattice"][1]) for r in frames.collect()] == [(50, 2.0)]


def test_selection_of_frames_and_elements(spark):
    df = spark.range(20).select(F.col("id").cast("int").alias("frame"), (F.col("id") % 3).cast("int").alias("type"))
    assert [r["frame"] for r in dumps.window(df, 2, 18, 3, 4).collect()] == [3, 6, 9]
    assert {r["element"] for r in dumps.with_elements(df, "0=Si,1=O", "X").collect()} == {"Si", "O", "X2"}
    species = spark.createDataFrame([("si", 1, 28.0), ("O", 2, 16.0)], "element string, type int, mass double")
    known = spark.createDataFrame([("Si",), ("2",)], "element string")
    assert sorted(r["mass"] for r in dumps.resolved(known, species).collect()) == [16.0, 28.0]
    with pytest.raises(Exception, match="no species for Xe"):
        dumps.resolved(spark.createDataFrame([("Xe",)], "element string"), species).collect()


STRUCTURE = "title\n\n3 atoms\n2 atom types\n\n0.0 10.0 xlo xhi\n0.0 11.0 ylo yhi\n-1 1 zlo zhi\n1 0 2 xy xz yz\n\nMasses\n\n1 28.08 # Si\n2 15.99 # O\n\nAtoms # charge\n\n1 1 2.4 0 0 0 0 0 1\n2 2 -1.2 1 1 1 0 0 0\n3 2 -1.2 2 2 2 0 0 0\n\nVelocities\n\n1 0.1 0.2 0.3\n"


def test_structure(spark, path, tmp_path):
    s = texts.structure(spark, path("a.data", STRUCTURE))
    assert s["box"].first().asDict() | {"path": ""} == {"path": "", "xlo": 0.0, "xhi": 10.0, "ylo": 0.0, "yhi": 11.0, "zlo": -1.0, "zhi": 1.0, "xy": 1.0, "xz": 0.0, "yz": 2.0}
    assert {(r["type"], r["element"], r["mass"]) for r in s["masses"].collect()} == {(1, "Si", 28.08), (2, "O", 15.99)}
    first = s["atoms"].orderBy("atom_id").first()
    assert (first["type"], first["charge"], first["x"], first["iz"], s["atoms"].count()) == (1, 2.4, 0.0, 1, 3)
    assert [r["vy"] for r in s["velocities"].collect()] == [0.2]
    texts.structure_text(s["atoms"], s["box"], s["masses"]).select("value").write.text(str(tmp_path / "out"))
    again = texts.structure(spark, str(tmp_path / "out"))
    assert again["atoms"].count() == 3 and again["masses"].count() == 2 and again["box"].first()["yhi"] == 11.0
    cell = "t\n\n1 atoms\n10 0 0 avec\n1 9 0 bvec\n0 2 8 cvec\n-1 -2 -3 abc origin\n\nAtoms\n\n1 1 0 0 0\n"
    b = texts.structure(spark, path("b.data", cell))["box"].first()
    assert (b["xlo"], b["xhi"], b["yhi"], b["zhi"], b["xy"], b["yz"]) == (-1.0, 9.0, 7.0, 5.0, 1.0, 2.0)


def test_logs(spark, path, tmp_path):
    log = "x\nStep Temp\n0 300\n10 301\nLoop time of 1\nrun\nStep Temp Press\n10 301 1\n20 299 2\nWARNING: hm\nLoop time of 2\n5 5\n"
    rows = texts.thermo(spark, path("log", log), ["Step", "Temp", "Press"]).orderBy("n").collect()
    assert [(r["section"], r["Step"], r["Press"]) for r in rows] == [(1, 0.0, None), (1, 10.0, None), (2, 10.0, 1.0), (2, 20.0, 2.0)]
    osz = "   N  E\n  391 T=  63. E= -.271E+04 F= -.27E+04 E0= -.26E+04  EK= 0.5E+01 SP= 0.1E-02 SK= 0.3E-03\n"
    assert texts.oszicar(spark, path("osz", osz)).first()["kinetic"] == 5.0
    assert texts.dipole_series(spark, path("dip", "# c\n 10  1 2   3\n20 1 2\n")).collect()[0]["mz"] == 3.0
    assert [(r["j"], r["r"]) for r in texts.bond_lists(spark, path("bonds", "1 0 0 0 2 2 5 1.5 6 1.75\n2 0 0 0 1 0\n")).collect()] == [(5, 1.5), (6, 1.75)]
    blocks = texts.counted_blocks(texts.lines(spark, path("eig", "1 2 2\n1 0.5\n2 0.7\n2 2 1\n1 0.9\n")))
    assert [(r["step"], r["row"], r["w"]) for r in blocks.orderBy("step", "row").collect()] == [(1, 1, ["1", "0.5"]), (1, 2, ["2", "0.7"]), (2, 1, ["1", "0.9"])]
    for n in (10, 2):
        (tmp_path / f"{n}.thermo.csv").write_text(f"Step,T\n{n},1\n")
    assert [r["file"] for r in texts.thermo_tables(spark, str(tmp_path / "*.thermo.csv")).orderBy("file").collect()] == [2, 10]


def test_curves_and_selections(spark):
    wide = texts.curve_table(spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0), ("a", 0.5, 1.0)], "label string, x double, y double"), ["a", "b"])
    assert [tuple(r) for r in wide.collect()] == [("0.500000", "1.000000", "0.000000"), ("1.000000", "2.000000", "3.000000")]
    lists = texts.id_lists(spark.createDataFrame([(0, 5), (0, 3)], "frame int, atom_id long"))
    assert texts.selection_text(lists).first()["expression"] == "ParticleIdentifier == 3 || ParticleIdentifier == 5"
    assert texts.dated("x.csv").endswith("_x.csv")


def test_streams(spark, tmp_path, sf_dir):
    from orrery.operators.series import binned
    from orrery.operators.voxels import voxel_fields
    from orrery.plans.views import VOXEL_BOX, dipoles, vox

    own = vox(spark, sf_dir).filter("frame < 3").cache()
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for frames in ("frame < 2", "frame = 2"):
        own.filter(frames).write.mode("append").parquet(source)
        jobs.stream_voxels(spark, source, out, mark, own.schema, 5.0, VOXEL_BOX, F.lit(1.0)).awaitTermination()
    whole = voxel_fields(own, 5.0, VOXEL_BOX, F.lit(1.0))
    assert spark.read.parquet(out).select("frame", "ix", "iy", "iz", "n").exceptAll(whole.select("frame", "ix", "iy", "iz", "n")).count() == 0
    assert spark.read.parquet(out).count() == whole.count()
    series = dipoles(spark, sf_dir).select("traj_id", "step", "mx", "my", "mz")
    series.repartition(1).sortWithinPartitions("step").write.parquet(str(tmp_path / "dip"))
    stream = spark.readStream.schema(series.schema).parquet(str(tmp_path / "dip"))
    query = jobs.running_bins(stream, 10).writeStream.format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "m2")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["traj_id"], r["step"]): r["variance"] for r in spark.table("bins").collect()}
    want = {(r["traj_id"], r["step"]): r["variance"] for r in binned(series, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_upserts_by_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, text in enumerate(('{"student": "a", "status": "MET"}\n{"student": "b", "status": "MET"}', '{"student": "a", "status": "NOT_MET"}')):
        (source / f"{k}.json").write_text(text)
        jobs.stream_results(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"), "student string, status string", ["student"]).awaitTermination()
    assert {(r["student"], r["status"]) for r in jobs.current(spark, str(tmp_path / "out"), ["student"]).collect()} == {("a", "NOT_MET"), ("b", "MET")}


@pytest.mark.parametrize("strategy", ["sliding", "cumulative", "hybrid", "binned"])
def test_running_averages_over_restarts(spark, tmp_path, strategy):
    """Samples that arrive in several runs of a stream give what the whole series gives."""
    from orrery.operators.series import averaged

    r = random.Random(4)
    rows = [(t, k, r.gauss(1, 2), r.gauss(0, 1), r.gauss(0, 3)) for t in range(3) for k in range(40 + 7 * t)]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    series = spark.createDataFrame(rows, jobs.SAMPLE)
    for low, high in ((0, 7), (7, 25), (25, 26), (26, 99)):
        series.filter((F.col("step") >= low) & (F.col("step") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(jobs.SAMPLE).parquet(source)
        jobs.running_averages(stream, strategy, 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = {(x["traj_id"], x["step"]): x["variance"] for x in spark.read.parquet(out).collect()}
    want = {(x["traj_id"], x["step"]): x["variance"] for x in averaged(series, strategy, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    spark.createDataFrame([(0, 3, 0.0, 0.0, 0.0)], jobs.SAMPLE).write.mode("append").parquet(source)
    late = jobs.running_averages(spark.readStream.schema(jobs.SAMPLE).parquet(source), strategy, 10).writeStream.format("noop").option("checkpointLocation", mark).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="comes after"):
        late.awaitTermination()


def test_a_batch_that_broke_is_written_once(spark, tmp_path, sf_dir, monkeypatch):
    """A stream that stops inside a batch goes on there, and nothing is written twice."""
    from orrery.operators.voxels import voxel_fields
    from orrery.plans.views import VOXEL_BOX, vox

    own = vox(spark, sf_dir).filter("frame < 3").cache()
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    own.filter("frame < 2").write.parquet(source)
    jobs.stream_voxels(spark, source, out, mark, own.schema, 5.0, VOXEL_BOX, F.lit(1.0)).awaitTermination()
    own.filter("frame = 2").write.mode("append").parquet(source)

    def breaks(*rows, **options):
        voxel_fields(*rows, **options).limit(3).write.mode("overwrite").parquet(f"{out}/batch=1")
        raise RuntimeError("the machine is gone")

    monkeypatch.setattr(jobs, "voxel_fields", breaks)
    with pytest.raises(Exception, match="the machine is gone"):
        jobs.stream_voxels(spark, source, out, mark, own.schema, 5.0, VOXEL_BOX, F.lit(1.0)).awaitTermination()
    monkeypatch.undo()
    jobs.stream_voxels(spark, source, out, mark, own.schema, 5.0, VOXEL_BOX, F.lit(1.0)).awaitTermination()
    whole = voxel_fields(own, 5.0, VOXEL_BOX, F.lit(1.0)).select("frame", "ix", "iy", "iz", "n")
    got = spark.read.parquet(out).select("frame", "ix", "iy", "iz", "n")
    assert got.count() == whole.count() and got.exceptAll(whole).count() == 0


def test_lines_of_split_files(spark, tmp_path):
    """Numbers and headers go on over the borders of a file's splits."""
    text = [f"line {k} " + "x" * (k % 17) if k % 50 else f"{k}" for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(text) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = lines(spark, str(tmp_path))
        assert rows.select("block").distinct().count() > 5
        assert [r["value"] for r in rows.orderBy("n").collect()] == text
        told = carried(rows, F.when(F.col("value").rlike(r"^\d+$"), F.col("value").cast("int")), "head").orderBy("n").collect()
        assert all(r["head"] == r["n"] // 50 * 50 for r in told)
        atoms = "".join(f"{n}\nAtoms. Timestep: {k}\n" + "".join(f"H {k} {j} 0\n" for j in range(n)) for k, n in ((k, k % 7 + 1) for k in range(400)))
        (tmp_path / "xyz").mkdir()
        (tmp_path / "xyz/b.xyz").write_text(atoms + "9\nAtoms. Timestep: 900\nH 1 1 1\n")
        frames, found = dumps.read_xyz(spark, str(tmp_path / "xyz/b.xyz"))
        assert {r["timestep"]: r["n_atoms"] for r in frames.collect()} == {k: k % 7 + 1 for k in range(400)}
        assert found.groupBy("timestep").count().filter("count <> timestep % 7 + 1").count() == 0 and found.filter("x <> timestep").count() == 0
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def test_last_of_a_key_in_a_batch(spark, tmp_path):
    """Six rows of one key, in a file and with a version that runs against it; the log told again in one batch."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(f'{{"k": "a", "v": {k}, "version": {9 - k}}}\n' for k in range(6)))
    jobs.stream_results(spark, source, out, mark, "k string, v int", ["k"]).awaitTermination()
    assert [r["v"] for r in jobs.current(spark, out, ["k"]).collect()] == [5]
    jobs.stream_results(spark, source, out + "2", mark + "2", "k string, v int, version int", ["k"], "version").awaitTermination()
    (tmp_path / "in" / "b.json").write_text('{"k": "a", "v": 77, "version": 2}\n{"k": "b", "v": 1, "version": 1}\n')
    jobs.stream_results(spark, source, out + "2", mark + "2", "k string, v int, version int", ["k"], "version").awaitTermination()
    want = [("a", 0), ("b", 1)]
    assert sorted((r["k"], r["v"]) for r in jobs.current(spark, out + "2", ["k"], "version").collect()) == want
    jobs.compacted(spark, out + "2", ["k"], out + "3", "version")
    assert sorted((r["k"], r["v"]) for r in jobs.current(spark, out + "3", ["k"], "version").collect()) == want


def test_formats(spark, path):
    from orrery.sources import formats

    kind = formats.detected(spark, path("f.trj", DUMP))
    assert kind.name == "dump" and kind.count(spark, path("f.trj", DUMP)) == 3 and kind.probe(spark, path("f.trj", DUMP))["n_atoms"] == 2
    assert sorted(r["timestep"] for r in kind.skip(spark, path("f.trj", DUMP), 1).collect()) == [100, 200]
    with pytest.raises(ValueError, match="no format"):
        formats.detected(spark, path("g.txt", "hello"))
