"""Records found by their declared counts, against a plain loop over lines."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.sources import dumps, texts
from orrery.sources.blocks import headed
from orrery.sources.lines import lines


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_weights_that_are_whole_numbers(spark, tmp_path):
    """A row that looks like a header is a row."""
    (tmp_path / "w").write_text("1 0 3\n1 0 5\n2 0 4\n3 1 1\n\n1 1 2\n2 0 1\n2 0 2\n2 0 9\n1 1 1\n")
    got = texts.band_weights(lines(spark, str(tmp_path / "w"))).drop("path").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, 0, 5.0), (1, 0, 2, 0, 4.0), (1, 0, 3, 1, 1.0), (1, 1, 2, 0, 1.0), (1, 1, 2, 0, 2.0)]


def test_comments_that_are_numbers(spark, tmp_path):
    (tmp_path / "x.xyz").write_text("2\n0\nH 0 0 0\nO 1 0 0\n2\n1\nH 0 0 1\nO 1 0 1\n3\n2\nH 0 0 0\n")
    frames, atoms = dumps.read_xyz(spark, str(tmp_path / "x.xyz"))
    assert sorted((r["timestep"], r["n_atoms"]) for r in frames.collect()) == [(0, 2), (1, 2)]
    assert sorted((r["timestep"], r["element"], r["z"]) for r in atoms.collect()) == [(0, "H", 0), (0, "O", 0), (1, "H", 1), (1, "O", 1)]


def plain_heads(text):
    out, n, rows = set(), 0, text.split("\n")
    rows = rows[:-1] if rows[-1] == "" else rows
    while n < len(rows):
        out.add(n)
        n += 1 + int(rows[n]) if rows[n].strip().isdigit() else 1
    return out


def test_many_splits_equal_one_loop(spark, tmp_path, small_splits):
    r = random.Random(4)
    want = {}
    for k in range(5):
        text = "".join(f"{r.choice([0, 1, 2, 3, 40, 7, 'a', ''])}\n" for _ in range(r.choice([1, 30, 300])))
        (tmp_path / f"f{k}").write_text(text)
        want |= {(k, n): True for n in plain_heads(text)}
    rows = lines(spark, str(tmp_path))
    assert rows.select("path", "block").distinct().count() > 8
    found = headed(rows, F.when(F.trim("value").rlike(r"^\d+$"), F.trim("value").cast("long") + 1)).filter("head")
    got = {(int(x["path"][-1]), x["n"]) for x in found.select("path", "n").collect()}
    assert got == set(want)


def test_frames_over_many_splits(spark, tmp_path, small_splits):
    r = random.Random(5)
    frames = [[(r.choice("HO"), r.randrange(9)) for _ in range(r.choice([1, 2, 30]))] for _ in range(12)]
    (tmp_path / "t.xyz").write_text("".join(f"{len(f)}\n{r.choice([3, 'Timestep: 7', ''])}\n" + "".join(f"{e} {x} 0 0\n" for e, x in f) for f in frames))
    _, atoms = dumps.read_xyz(spark, str(tmp_path / "t.xyz"))
    assert sorted((a["element"], a["x"]) for a in atoms.collect()) == sorted((e, float(x)) for f in frames for e, x in f)
    (tmp_path / "b").write_text("".join(f"{k} 5 {len(f)}\n" + "".join(f"{x} {x} {x}\n" for _, x in f) for k, f in enumerate(frames)))
    rows = texts.counted_blocks(lines(spark, str(tmp_path / "b"))).collect()
    assert sorted((x["step"], x["row"], x["w"][0]) for x in rows) == sorted((k, i + 1, str(x)) for k, f in enumerate(frames) for i, (_, x) in enumerate(f))
