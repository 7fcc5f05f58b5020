"""Hard negatives against plain loops, and ids that doubles don't hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import hard_negatives, queries, topk


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def plain(rows, k=5):
    """Every anchor against every row."""
    part = []
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v):
            part.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for n, (i, q, label) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0, lab) for m, (j, v, lab) in enumerate(part) if m != n and len(v) == len(q)]
        for p, no, j, _ in sorted(x for x in scored if x[3] == label)[:k]:
            fit = sorted(x for x in scored if x[3] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)
            out += [(i, None if no else j, r + 1, None if none else m, -p, -s) for r, (s, none, m, _) in enumerate(fit[:k])]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    vectors = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, key string, part int")
    return sorted(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label(), **more).collect()), key=str)


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_mining_equals_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "STEP", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    r = random.Random(block)
    rows = [(k, [r.gauss(0.1, 1) for _ in range(10)], r.randrange(4)) for k in range(0, 900, 2)]
    rows += [(k, [0.25] * 10, k % 3) for k in range(1000, 1030)]  # ties
    rows += [(100, [0.5] * 10, 1), (100, [0.5] * 10, 1), (rows[3][0], *rows[3][1:])]  # repeated ids and rows
    rows += [(None, [0.3] * 10, 1), (None, [0.3] * 10, 2), (5, None, 1), (6, [], 1), (7, [float("nan")] * 10, 1), (8, [None] * 10, 1), (9, [float("inf")] * 10, 1), (200, [1.0] * 10, None), (300, [1.0, 2.0], 1), (301, [1.0, 2.0], 1), (303, [1.0, 1.5], 2)]
    assert mined(spark, rows) == plain(rows)


def test_numbers_of_every_size(spark):
    """Scores beyond 53 bits, all negative ones, ids beyond 53 bits beside null ids."""
    r = random.Random(3)
    big = 1 << 53
    large = [(k * 50, [r.choice([1.0, 4.0e6, 3.9e6, 0.5]) for _ in range(3)], k % 2) for k in range(60)]
    below = [(k * 50, [-1.0 if k % 3 else 1.0, 0.5], k % 2) for k in range(20)]
    ids = [(100, [1.0], 1), (big + 1, [1.0], 1), (big + 3, [1.0], 2), (None, [1.0], 2), (None, [1.0], 1)]
    for rows in (large, below, ids):
        assert mined(spark, rows) == plain(rows)
    assert (100, big + 1, 1, big + 3, 65536, 65536) in mined(spark, ids)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(100, [2.0**30] * 2, 1), (1, [2.0**30] * 2, 1)])


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_the_bitmap_shrinks():
    """Far candidates are not read to the end; what stays has its exact score."""
    r = np.random.default_rng(1)
    near, far = r.integers(90, 110, (40, 64)), r.integers(-110, 110, (4000, 64))
    columns = np.concatenate([near, far]).T.astype(float)
    q = r.integers(90, 110, 64)
    asked = []

    def keep(low, high):
        asked.append(len(low))
        return hard_negatives.among_best(5)(low, high)

    at, score = hard_negatives.vertical(q, columns, columns.min(1), columns.max(1), np.ones(4040, bool), keep)
    assert asked[0] == 4040 and asked[-1] < 100 and set(np.argsort(-(q @ columns), kind="stable")[:5]) <= set(at)
    assert (score == (q @ columns)[at]).all()
    assert hard_negatives.window_of(-7) == (-5, -7) and hard_negatives.window_of(7) == (6, 7)


def test_search_keeps_ids_beside_null_ids(spark):
    big = 1 << 53
    rows = [(big + 1, [1.0, 0.5]), (None, [1.0, 0.5]), (50, [1.0, 0.25]), (None, [0.5, 0.5]), (big + 3, [1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(vectors, F.col("vec_id") % 50 == 0, 4).collect()))
    assert got == [(50, 1, big + 1, 73728), (50, 2, big + 3, 73728), (50, 3, None, 73728), (50, 4, None, 40960)]
    asked = topk.search(vectors, F.col("vec_id").isNull(), 1).collect()
    assert sorted(map(tuple, asked)) == [(None, 1, big + 1, 40960 + 8192), (None, 1, big + 1, 65536 + 16384)]


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    found = con.execute(hard_negatives.ORACLE)
    got = queries.op13_hard_negatives(spark, sf_dir).select(*(d[0] for d in found.description))
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["topk", "hard_negatives"])
def test_blocks_are_not_sent_by_the_driver(spark, name):
    """Blocks are met by a shuffle, however short the planner takes them for, and hold no more bytes than their numbers need."""
    r = random.Random(5)
    vectors = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)], k % 3) for k in range(400)], "vec_id long, embedding array<double>, label int")
    asked = F.col("vec_id") % 100 == 0
    found = topk.search(vectors, asked) if name == "topk" else hard_negatives.mine(vectors, asked, F.col("label"))
    ran = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dimension" in ran and "BroadcastHashJoin [dimension" not in ran
    for low, high, kind in ((-128, 127, "i1"), (-129, 0, "i2"), (0, 1 << 15, "i4"), (-(1 << 31) - 1, 5, "i8")):
        x = np.array([[low, 0], [high, 1]])
        held = topk.narrow(x.ravel())
        assert held.dtype == kind and (topk.matrix(held.tobytes(), 2, 2) == x).all()
