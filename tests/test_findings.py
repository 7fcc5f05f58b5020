"""Steps that must not grow with density, with the number of files, or with the length of one."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.operators.neighbors import partner_distances


def cloud(n, size, seed=0, **more):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"frame": 0, "atom_id": np.arange(n), "type": np.arange(n) % 3 + 1, **{a: np.round(rng.random(n) * size, 3) for a in "xyz"}, **more})


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_partner_cells_follow_density(spark):
    """Many partners within the reach are split into cells; before, all of them were one cell."""
    a, b = cloud(500, 1.0), cloud(4000, 1.0, 1)
    found = partner_distances(spark.createDataFrame(a), spark.createDataFrame(b), 2.0)
    assert "shiftright" in plan(found).lower() and plan(found).lower().count("_bound") > plan(partner_distances(spark.createDataFrame(a[:9]), spark.createDataFrame(b[:9]), 2.0)).lower().count("_bound")
    d = a[["x", "y", "z"]].to_numpy()[:, None] - b[["x", "y", "z"]].to_numpy()[None]
    want = np.sqrt((d**2).sum(2).min(1))
    got = found.orderBy("atom_id").toPandas()
    assert np.allclose(got["distance"], want, rtol=0, atol=1e-12)


def test_nearest_within_blocks_hold_few_pairs(spark, monkeypatch):
    """most= neither lists all pairs within the radius, nor loses ties or far neighbours."""
    import pyarrow as pa

    from orrery.operators import neighbors

    rows = pd.concat([cloud(2500, 1.0), cloud(20, 20.0, 3).assign(atom_id=lambda t: t["atom_id"] + 5000)])
    block = pa.Table.from_pandas(rows.assign(**{f"_p{k}": rows[a] for k, a in enumerate("xyz")}, **{f"_l{k}": 20.0 for k in range(3)}, **{f"_n{k}": 1 for k in range(3)}, _center=rows["type"] == 2, _wing=rows["type"] == 3))
    search = neighbors.Search(4.0, 0.0, False, False, (True,) * 3, False)
    monkeypatch.setattr(neighbors, "HELD_PAIRS", 5000)
    i, j, _, r = search.near(block)
    ids = rows["atom_id"].to_numpy()
    order = np.lexsort((ids[j], r, i))
    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < 4]
    got = search.nearest(block, 4)
    assert sorted(zip(i[order], j[order], r[order])) == sorted(zip(got[0], got[1], got[3]))


def test_pair_survival_counts_in_blocks(spark):
    """The counts are those of the pairs as rows, of atoms that move, leave and change their side."""
    from orrery.operators import dynamics
    from orrery.operators.neighbors import pairs

    start = cloud(300, 20.0)
    rows = pd.concat([start.assign(frame=f, **{a: (start[a] + f * (start["atom_id"] % 7 - 3) * 0.15) % 20 for a in "xyz"}) for f in range(6)])
    rows["type"] = rows["type"].where((rows["atom_id"] != 7) | (rows["frame"] < 3), 1)
    df = spark.createDataFrame(rows[(rows["atom_id"] + rows["frame"]) % 11 != 0])
    center, wing = F.col("type") == 2, F.col("type") == 3
    want = dynamics.survival(pairs(df, 2.5, (20.0,) * 3, center=center, wing=wing), 3, 2, 6)
    got = dynamics.pair_survival(df, 2.5, (20.0,) * 3, 3, 2, 6, center, wing)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    assert "_path" in plan(got)


def test_tilted_vectors_keep_the_places_digits(spark):
    """Vectors in a tilted cell are differences of the given places and whole cell vectors, to the last bit."""
    from orrery.operators.neighbors import pairs

    rows = cloud(200, 20.0)
    got = pairs(spark.createDataFrame(rows), 4.0, (20.0,) * 3, tilt=(7.25, -3.5, 8.75)).toPandas()
    at = rows[["x", "y", "z"]].to_numpy()
    d = at[got["j"]] - at[got["i"]]
    n = np.zeros((len(d), 3))
    n[:, 2] = np.floor(d[:, 2] / 20 + 0.5)
    n[:, 1] = np.floor((d[:, 1] - n[:, 2] * 8.75) / 20 + 0.5)
    n[:, 0] = np.floor((d[:, 0] + n[:, 2] * 3.5 - n[:, 1] * 7.25) / 20 + 0.5)
    want = np.stack([d[:, 0] - n[:, 2] * -3.5 - n[:, 1] * 7.25 - n[:, 0] * 20, d[:, 1] - n[:, 2] * 8.75 - n[:, 1] * 20, d[:, 2] - n[:, 2] * 20], 1)
    assert len(got) > 100 and (got[["dx", "dy", "dz"]].to_numpy() == want).all()


def test_reciprocal_points_of_a_flat_cell(spark):
    """A frame whose cell has no volume gives no points and no error; others have their own points alone."""
    from orrery.operators import distributions as dist

    rows = pd.concat([cloud(30, 10.0).assign(frame=f, lx=20.0, ly=ly, lz=22.0, xy=3.0, xz=-1.5, yz=2.0) for f, ly in ((0, 21.0), (1, 0.0))])
    df = spark.createDataFrame(rows)
    got, want = dist.reciprocal_cells(df, 1.0, 0.25), dist.reciprocal_cells(df.filter("frame = 0"), 1.0, 0.25)
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sliding_sums_keep_their_digits():
    """A window's sum is as exact as its own terms, however much was summed before it."""
    from orrery.streaming.jobs import window_sums

    terms = np.concatenate([np.full((1000, 1), 1e15 + 0.125), np.full((40, 1), 0.1)])
    ends = np.arange(1, len(terms) + 1)
    counts = np.minimum(ends, 7)
    got = window_sums(terms, ends, counts, 7)[:, 0]
    assert abs(got[-1] - 0.7) < 1e-12 and np.allclose(got, [terms[e - c : e].sum() for e, c in zip(ends, counts)], rtol=1e-14, atol=1e-12)


def test_half_of_a_band_does_not_dominate(spark):
    from orrery.operators.bands import dominated

    rows = pd.DataFrame([(b, a, 1 + (b > 0 and a % 3)) for b in range(40) for a in range(2 * (b + 1))], columns=["band", "atom", "weight"])
    rows["weight"] = np.where(rows["atom"] % 2 == 0, rows["band"] + 1, rows["band"] + 1)
    assert dominated(spark.createDataFrame(rows), F.col("atom") % 2 == 0).count() == 0
    assert dominated(spark.createDataFrame(rows), (F.col("atom") % 2 == 0) | (F.col("atom") == 1)).count() == 40


def test_headers_leave_text_out_of_python(spark):
    """Only numbers of lines go through Python where headers are followed, in blocks that don't depend on the file's splits."""
    from orrery.sources.blocks import headed

    rows = spark.createDataFrame(pd.DataFrame({"path": "a", "block": 0, "n": np.arange(12), "value": ["3"] + ["x"] * 2 + ["9"] + ["x"] * 8}))
    found = headed(rows, F.when(F.col("value").rlike("^[0-9]+$"), F.col("value").cast("bigint")))
    assert [r["n"] for r in found.filter("head").orderBy("n").collect()] == [0, 3]
    cogroup = next(x for x in plan(found).split("\n") if "FlatMapCoGroups" in x)
    assert "value" not in cogroup


def repaired_plainly(rows, cutoff, size, surface, spare):
    """up, down, new and twice of one frame's atoms, by comparing all of them with all."""
    at = rows[["x", "y", "z"]].to_numpy(float)
    d = at[:, None] - at[None]
    d[..., :2] -= size * np.rint(d[..., :2] / size)
    flat = d[..., 0] ** 2 + d[..., 1] ** 2
    other = ~np.eye(len(at), dtype=bool)
    free = lambda dz: ~((np.sqrt(flat + dz**2) <= cutoff) & other).any(1)
    open_ = lambda z: free(z[:, None] - z[None])
    z = at[:, 2]
    dz = d[..., 2]
    lost = free(dz - size * np.rint(dz / size)) if spare else np.zeros(len(z), bool)
    near = size if surface is None else surface
    up = open_(z) & ~lost & (z <= size / 2) & (z <= near)
    z = z + size * up
    high = open_(z) & ~lost & (z > size / 2) & (z >= (-np.inf if surface is None else size - near))
    z = z - size * (high & ~up)
    return pd.DataFrame({"frame": rows["frame"], "atom_id": rows["atom_id"], "z": z, "up": up, "down": high & ~up, "new": open_(z) & ~lost, "twice": high & up})


def test_edges_are_repaired_by_one_search(spark):
    """No pair leaves its block and no table is written; boxes of many blocks, atoms outside, and such without a place too."""
    from orrery.operators.structure import repair_edges

    for size, cutoff, n, surface, spare in ((20.0, 1.8, 300, None, True), (20.0, 1.2, 300, 2.5, False), (36.0, 1.0, 2500, None, True), (36.0, 1.0, 2500, 3.0, False), (5.0, 2.6, 30, None, False)):
        rows = pd.concat([cloud(n, size, f, tag="a").assign(frame=f) for f in range(2)], ignore_index=True)
        rows.loc[rows["atom_id"] % 50 == 7, "z"] += size * 1.25
        if cutoff > size / 2:  # several images of a pair along the axis
            rows["x"], rows["y"] = rows["x"] * 4, rows["y"] * 4
        box = (size * 4, size * 4, size) if cutoff > size / 2 else (size,) * 3
        odd = pd.DataFrame([{"frame": 0, "atom_id": n + 1, "type": 1, "x": None, "y": 1.0, "z": 1.0, "tag": "b"}, {"frame": 1, "atom_id": n + 2, "type": 1, "x": 1.0, "y": 1.0, "z": float("nan"), "tag": "b"}])
        df = spark.createDataFrame(list(pd.concat([rows, odd]).astype(object).replace({np.nan: None}).itertuples(index=False, name=None)), "frame int, atom_id long, type int, x double, y double, z double, tag string")
        whole, report = repair_edges(df, cutoff, box, surface=surface, spare_free=spare, refitted=False)
        assert not any(x in plan(report) + plan(whole) for x in ("Join", "parquet"))
        if cutoff > size / 2:
            assert report.count() == 2 and whole.count() == df.count()
            continue
        want = pd.concat([repaired_plainly(t, cutoff, size, surface, spare) for _, t in rows.groupby("frame")])
        got = whole.toPandas()
        assert len(got) == len(rows) + 2 and set(got.columns) == {*df.columns, "lx", "ly", "lz"}
        met = got.merge(want, on=["frame", "atom_id"])
        assert len(met) == len(want) and (met["z_x"] == met["z_y"]).all() and want["up"].any()
        moved = not spare and surface is not None
        lone = {0: (int(moved), 0, int(moved), int(moved)), 1: (0, 0, int(moved), 0)}
        for r in report.collect():
            t = want[want["frame"] == r["frame"]]
            assert tuple(r)[1:5] == tuple(int(t[c].sum()) + k for c, k in zip(("up", "down", "new", "twice"), lone[r["frame"]]))


def test_refitted_repairs_write_no_table(spark):
    """Where the repaired atoms lie in their box needs neither tables between its steps nor pairs as rows."""
    from orrery.operators.structure import repair_edges

    rows = cloud(200, 20.0)
    whole, _ = repair_edges(spark.createDataFrame(rows), 1.8, (20.0,) * 3)
    assert plan(whole).count("Join") == 1 and "parquet" not in plan(whole)
    want = repaired_plainly(rows, 1.8, 20.0, None, True).set_index("atom_id")["z"]
    got = whole.toPandas().set_index("atom_id")
    assert want.nunique() > 100 and np.allclose(got["z"], want[got.index] - want.min() + 1, rtol=0, atol=1e-12) and np.allclose(got["lz"], np.ptp(want) + 2)


def test_xyz_files_hold_many_frames(spark, monkeypatch, tmp_path):
    """The number of files doesn't grow with the frames, and every atom comes back once with its lattice."""
    from orrery.plans import reading

    rows = pd.concat([cloud(5 + f % 3, 20.0, f).assign(frame=f, atom_id=lambda t, f=f: t["atom_id"] + 100 * f) for f in range(40)])
    monkeypatch.setattr(reading, "atoms", lambda spark, sf: spark.createDataFrame(rows))
    monkeypatch.setattr(reading, "scratch", lambda spark: str(tmp_path / "xyz"))
    got = reading.xyz_roundtrip(spark, "").toPandas().set_index("atom_id").sort_index()
    assert len(list((tmp_path / "xyz").rglob("*.txt"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = rows.set_index("atom_id").sort_index()
    assert list(got.index) == list(want.index) and (got[["x", "y", "z"]] == want[["x", "y", "z"]]).all(axis=None)
    assert set(got["edge"]) == {20.024} and list(got["element"]) == [{1: "Si", 2: "O", 3: "H"}[t] for t in want["type"]]


def test_structure_files_are_opened_once(spark, monkeypatch, tmp_path):
    """One file for each frame, in one folder; their parts come from the lines written once, not from the files again."""
    from orrery.plans import reading
    from orrery.sources import texts

    rows = pd.concat([cloud(5 + f % 3, 20.0, f).assign(frame=f, atom_id=lambda t, f=f: t["atom_id"] + 100 * f) for f in range(40)])
    monkeypatch.setattr(reading, "atoms", lambda spark, sf: spark.createDataFrame(rows))
    monkeypatch.setattr(reading, "scratch", lambda spark: str(tmp_path / "files"))
    got = reading.structure_files(spark, "").toPandas().set_index("atom_id").sort_index()
    assert len(list((tmp_path / "files").glob("*.txt"))) == 40
    want = rows.set_index("atom_id").sort_index()
    assert list(got.index) == list(want.index) and (got[["x", "y", "z"]] == want[["x", "y", "z"]]).all(axis=None) and set(got["edge"]) == {20.024}
    for part in texts.structure(spark, str(tmp_path / "files")).values():
        assert not any(name.endswith(".txt") for name in part.inputFiles())


def test_refitted_repairs_search_once(spark):
    """Ends and atoms of the refitted box are read behind one search; before, each had its own, and constants went along with every atom."""
    from orrery.operators.structure import repair_edges

    rows = spark.createDataFrame(cloud(200, 20.0)).withColumn("tags", F.create_map(F.lit("kind"), "type"))
    whole, _ = repair_edges(rows, 1.8, (20.0,) * 3)
    plain = whole.select("frame", "atom_id", "x", "y", "z", "lz")
    assert len(plain.collect()) == 200
    ran = plain._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("FlatMapGroupsInArrow") == 1 and "ReusedExchange" in ran
    searched = next(x for x in plan(whole).split("\n") if "FlatMapGroupsInArrow" in x)
    assert not any(c in searched for c in ("_l0", "_n0", "_b0", "_wing", "_center"))
    assert whole.filter(F.col("tags")["kind"] == F.col("type")).count() == 200


def test_streamed_samples_are_halved_once(spark, monkeypatch, sf_dir):
    """The middle that parts a stream's two runs is told once; an approximate one, told anew for each run, loses samples where it moves."""
    from orrery.plans import changes

    told = spark.sparkContext.accumulator(0)

    def middle(steps: pd.Series) -> int:
        told.add(1)
        return int(steps.median())

    spark.udf.register("middle", F.pandas_udf(middle, "long", F.PandasUDFType.GROUPED_AGG))
    expr = F.expr
    monkeypatch.setattr(changes.F, "expr", lambda text: expr("middle(step)") if "percentile_approx" in text else expr(text))
    rows = changes.stream_hybrid(spark, sf_dir)
    assert told.value == 1
    assert rows.select("traj_id", "step").distinct().count() == rows.count() == changes.dipoles(spark, sf_dir).count()


def shuffled(node):
    """Rows that a plan's exchanges wrote when it was run."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return shuffled(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return shuffled(node.plan())
    written = node.metrics().get("shuffleRecordsWritten")
    children = node.children()
    return (written.get().value() if written.isDefined() else 0) + sum(shuffled(children.apply(k)) for k in range(children.size()))


def test_reciprocal_points_are_no_rows(spark, monkeypatch):
    """A task that has a frame's atoms sums over its points where they are made; dealt by points or by atoms, the sums are the same."""
    from orrery.operators import distributions as dist

    df = spark.createDataFrame(cloud(60, 40.0).assign(lx=40.0, ly=-42.0, lz=38.0, xy=30.0, xz=-1.5, yz=50.0))
    found = dist.reciprocal_cells(df, 3.0, 0.25)
    want = {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()}
    points = sum(n for (a, b, _), (n, _) in want.items() if a == b == 1)
    assert points > 10000 and shuffled(found._jdf.queryExecution().executedPlan()) < 3000  # before, each point of each kind was a row
    for atoms, terms in ((1 << 17, 60 * 2000), (25, 1 << 34), (25, 20 * 2000)):
        monkeypatch.setattr(dist, "WHOLE", atoms)
        monkeypatch.setattr(dist, "TERMS", terms)
        got = {tuple(r)[:3]: tuple(r)[3:] for r in dist.reciprocal_cells(df, 3.0, 0.25).collect()}
        assert set(got) == set(want) and all(got[k][0] == n and abs(got[k][1] - s) < 1e-9 for k, (n, s) in want.items())


def test_leaning_cells_look_at_few_indices():
    """Indices follow the lean of a cell; before, all that any lean of that length could need were looked at."""
    from orrery.operators.distributions import cell_planes

    for lean in (0.0, 1e6):
        planes = list(cell_planes((20.0, 21.0, 22.0, 0.0, 0.0, lean), 1.0))
        assert sum(p[5].size for p in planes) < 1000 and 60 < sum(p[5].sum() for p in planes) < 100


def test_lists_of_dumps_stay_with_the_tasks(spark, tmp_path, monkeypatch):
    """A list's paths aren't handed to Spark one by one; blank lines, repeated and compressed files keep their places."""
    import gzip

    from orrery.sources import dumps

    def text(f):
        return "ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 9\n0 9\n0 9\nITEM: ATOMS id type x y z\n%d 1 0.5 0 0\n" % (f * 10, f)

    for f in range(30):
        (tmp_path / f"d {f}.txt").write_text(text(f))
    order = [7, 3, *range(8, 30), 3]
    (tmp_path / "list").write_text("\n".join(("file:" if k % 2 else "") + f"{tmp_path}/d {f}.txt" + ("\n" if k == 1 else "") for k, f in enumerate(order)))
    read, seen = dumps.read_dump, []
    monkeypatch.setattr(dumps, "read_dump", lambda spark, path, *more: seen.append(path) or read(spark, path, *more))
    frames, atoms = dumps.read_listed(spark, str(tmp_path / "list"))
    assert not any(isinstance(path, list) for path in seen)
    shown = plan(atoms)
    assert "MapInArrow" in shown and "Join" not in shown[: shown.index("MapInArrow")]  # atoms, taken for short, would be sent by the driver
    assert sorted((r["frame"], r["timestep"] // 10) for r in frames.collect()) == list(enumerate(order))
    assert sorted((r["frame"], r["atom_id"]) for r in atoms.collect()) == list(enumerate(order))
    (tmp_path / "z.gz").write_bytes(gzip.compress(text(40).encode()))
    (tmp_path / "y.txt").write_text(text(5))
    (tmp_path / "list").write_text(f"{tmp_path}/y.txt\n{tmp_path}/z.gz\n")
    frames, atoms = dumps.read_listed(spark, str(tmp_path / "list"))
    assert sorted((r["frame"], r["timestep"]) for r in frames.collect()) == [(0, 50), (1, 400)]
    assert sorted((r["frame"], r["atom_id"]) for r in atoms.collect()) == [(0, 5), (1, 40)]


def test_lasting_pairs_are_products(monkeypatch):
    """Pairs are counted by products of places, and told exactly where these are in doubt, at the radius itself too."""
    from orrery.operators import dynamics

    rng = np.random.default_rng(4)
    a, b = (np.round(rng.random((n, 3)) * 8, 1) for n in (60, 90))
    paths = [[x + k * 0.1 * np.round(rng.standard_normal(x.shape)) for k in range(4)] for x in (a, b)]
    fits = [[rng.random(len(x)) > 0.1 * (k > 0) for k in range(4)] for x in (a, b)]
    near = [np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)) <= 2.5 for p, q in zip(*paths)]
    same = np.arange(60)[:, None] == np.arange(90)[None]
    held, want = ~same, []
    for k in range(4):
        held = held & near[k] & (fits[0][k][:, None] & fits[1][k][None])
        want.append(held.sum())
    told = []
    exact = lambda k, i, j: told.append(len(i)) or near[k][i, j]
    cells = lambda: iter([(np.arange(0, 25), np.arange(90)), (np.arange(25, 60), np.arange(90))])
    for fit, most in ((fits, 1 << 18), (fits, 100)):
        got = dynamics.lasting(cells(), *paths, *fit, 2.5, exact, lambda i, j: same[np.ix_(i, j)], most)
        if fit[0][0].all() and fit[1][0].all():
            assert list(got) == want
    assert list(got) == want and 0 < sum(told) < 2 * 60 * 90


def test_files_of_an_index_are_written_by_lines(spark, sf_dir, monkeypatch):
    """Lines are those of the frames' texts, and no frame of an indexed file is one row."""
    from orrery.plans import reading
    from orrery.sources import dumps

    rows = spark.createDataFrame(pd.concat([cloud(7, 9.0, f).assign(frame=f, atom_id=lambda t: 9 - t["atom_id"]) for f in (2, 0, 1)]))
    columns = ("atom_id", "type", "x", "y", "z")
    heads = reading.bounds(rows, 9.0)
    text = "\n".join(r["value"] for r in dumps.frame_text(rows, heads, columns).orderBy("frame").collect())
    assert "\n".join(r["value"] for r in dumps.frame_lines(rows, heads, columns).coalesce(1).collect()) == text
    monkeypatch.setattr(dumps, "frame_text", None)
    assert reading.format_index(spark, sf_dir).count() == 46
