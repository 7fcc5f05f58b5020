"""Dumps by byte ranges against the same files read whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.sources import dumps

COLUMNS = ("atom_id", "type", "x", "element")


def made(r, end="\n"):
    """A dump with frames of every size, with other items between them, blanks, blank lines, and a broken last frame."""
    out, frames = ["junk before", "ITEM: UNITS", "metal"] if r.random() < 0.5 else [], []
    for k in range(r.randrange(1, 7)):
        n = r.choice([0, 1, 2, 17])
        names = r.sample(["id", "type", "x", "y", "element"], 5)
        if r.random() < 0.3:
            out += ["ITEM: TIME", "0.5"]
        out += ["ITEM: TIMESTEP", str(k * 10), "ITEM: NUMBER OF ATOMS", str(n), "ITEM: BOX BOUNDS pp pp ff", "0 10", "-1 9.5", "0 5e0", "ITEM: ATOMS " + " ".join(names) + r.choice(["", " "])]
        rows = [{"id": r.randrange(1 << 40), "type": r.randrange(3), "x": r.randrange(-999, 999) / 8, "y": 1.5, "element": r.choice(["Si", "O"])} for _ in range(n + r.choice([0, 0, 2]))]
        gap = r.choice([" ", "  ", "\t"])
        for row in rows:
            out.append(r.choice(["", "", " "]) + gap.join(str(row[c]) for c in names) + r.choice(["", " "]))
            out += [""] if r.random() < 0.05 else []
        frames.append((k * 10, [(row["id"], row["type"], row["x"], row["element"]) for row in rows[:n]]))
    if r.random() < 0.5:
        out += ["ITEM: TIMESTEP", "999", "ITEM: NUMBER OF ATOMS", "5", "ITEM: BOX BOUNDS pp pp pp", "0 1", "0 1", "0 1", "ITEM: ATOMS id type x y element", "1 1 0 0 Si"]
    if r.random() < 0.3:
        out += ["ITEM: TIMESTEP", "1000", "ITEM: NUMBER OF"]
    return end.join(out) + r.choice(["", end]), frames


@pytest.mark.parametrize("size", [13, 64, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, size):
    r = random.Random(size)
    want = {}
    for k in range(12):
        text, frames = made(r, r.choice(["\n", "\n", "\r\n"]))
        (tmp_path / f"d{k}.dump").write_bytes(text.encode())
        want |= {(k, t): rows for t, rows in frames}
    frames, atoms = dumps.read_dump(spark, str(tmp_path), COLUMNS, size=size)
    number = F.regexp_extract("path", r"d(\d+)\.dump", 1).cast("int").alias("k")
    heads = {(h["k"], h["timestep"]): h for h in frames.select(number, "*").collect()}
    assert set(heads) == set(want) and all(h["n_atoms"] == len(want[k]) and h["ylo"] == -1 and h["zhi"] == 5 and h["pbc"] == [True, True, False] for k, h in heads.items())
    got = {k: [] for k in want}
    for a in atoms.select(number, "timestep", *COLUMNS).collect():
        got[a["k"], a["timestep"]].append(tuple(a)[2:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_small_reads_equal_large_ones(tmp_path):
    """Wherever a buffer of the search or of the parser ends, the pieces tell the same frames."""
    import pyarrow as pa

    r = random.Random(9)
    for k in range(60):
        text, frames = made(r)
        path = str(tmp_path / f"{k}.dump")
        (tmp_path / f"{k}.dump").write_text(text)
        n = len(text)
        cut = r.choice([n, 50, 211])
        batch = pa.RecordBatch.from_pylist([{"path": path, "length": n, "begin": b, "end": min(b + cut, n)} for b in range(0, n, cut)])
        one, other = ([p for b in dumps.pieces_of([batch], step) for p in b.to_pylist()] for step in (1 << 20, r.choice([1, 7, 40])))
        assert one == other
        assert sum(p["lines"] for p in one if p["timestep"] is not None or not p["head"]) >= sum(len(x) for _, x in frames)


def test_frame_of_two_million_atoms_is_many_tasks_work(spark, tmp_path):
    n = 2_000_000
    ids = np.arange(n)
    with open(tmp_path / "large.dump", "w") as f:
        for step, m in ((0, 10), (5, n), (7, 10)):
            f.write(f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{m}\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ATOMS id type x y z\n")
            f.write("\n".join(f"{i} 1 0.5 0.25 {i % 8}" for i in ids[:m]) + "\n")
    frames, atoms = dumps.read_dump(spark, str(tmp_path), ("atom_id", "z"), where=F.col("timestep") == 5, size=4 << 20)
    assert [tuple(x) for x in frames.select("timestep", "n_atoms").collect()] == [(5, n)]
    found = atoms.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("atom_id").alias("ids"), F.sum("z").alias("z")).collect()
    assert sum(t["n"] for t in found) == n and sum(t["ids"] for t in found) == n * (n - 1) // 2 and sum(t["z"] for t in found) == n * 3.5
    pieces = dumps.dump_pieces(spark, str(tmp_path), 4 << 20).filter("timestep = 5")
    assert pieces.count() > 5 and pieces.agg(F.max(F.col("until") - F.col("piece"))).first()[0] < 5 << 20
    plan = atoms._jdf.queryExecution().toString()
    assert "timestep" in plan and "Filter" in plan and " y" not in plan.split("== Physical Plan ==")[1].split("\n")[2]


def test_missing_columns_and_odd_paths(spark, tmp_path):
    (tmp_path / "a.dump").write_text("ITEM: TIMESTEP\n1\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ATOMS id x\n1 2\n")
    with pytest.raises(Exception, match="no column vx"):
        dumps.read_dump(spark, str(tmp_path), ("atom_id", "vx"))[1].collect()
    (tmp_path / "empty.dump").write_text("")
    assert dumps.read_dump(spark, str(tmp_path / "empty.dump"))[1].count() == 0
    import gzip

    with gzip.open(tmp_path / "b.dump.gz", "wt") as f:
        f.write((tmp_path / "a.dump").read_text())
    assert [tuple(x) for x in dumps.read_dump(spark, str(tmp_path / "b.dump.gz"), ("atom_id", "x"))[1].select("timestep", "atom_id", "x").collect()] == [(1, 1, 2.0)]
