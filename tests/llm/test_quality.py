"""Quality scores against one matrix of all rows, on held-out rows, and on odd texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import quality, queries
from orrery.llm.common import table


def fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def plain(described, labels):
    """Scores of all rows by dense algebra over the whole learning matrix, folds left out one by one."""
    learn = described.join(labels.withColumnRenamed("doc_id", "id"), "id").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(quality.FOLDS))).toPandas()
    x, y, of = np.stack(learn["x"].to_list()), learn["quality"].to_numpy(float), learn["fold"].to_numpy()
    mean, spread = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = quality.fourier(x, mean, spread)

    def ridge(rows, lam):
        free = np.diag([*[1.0] * quality.FEATURES, 1e-9])
        return np.linalg.solve(z[rows].T @ z[rows] + lam * free, z[rows].T @ y[rows])

    def unseen(lam):
        out = np.zeros(len(y))
        for k in range(quality.FOLDS):
            out[of == k] = z[of == k] @ ridge(of != k, lam)
        return out

    lam = min(quality.RIDGES, key=lambda r: ((unseen(r) - y) ** 2).sum())
    raw = unseen(lam)
    bins = np.floor(np.clip(raw, -1, 2) * quality.BINS).astype(int)
    at = sorted(set(bins))
    centre, share, n = ([f(bins == b) for b in at] for f in (lambda m: raw[m].mean(), lambda m: y[m].mean(), lambda m: m.sum()))
    # least rising majorant by minimum over ends of maximum over beginnings
    centre, share, n = map(np.array, (centre, share, n))
    total, weight = np.cumsum(np.append(0, share * n)), np.cumsum(np.append(0, n))
    level = [max(min((total[j] - total[i]) / (weight[j] - weight[i]) for j in range(k + 1, len(n) + 1)) for i in range(k + 1)) for k in range(len(n))]
    centres, values = [], []
    for v in sorted(set(np.round(level, 12))):
        m = np.abs(np.array(level) - v) < 1e-9
        centres.append((centre[m] * n[m]).sum() / n[m].sum())
        values.append(v)
    rows = described.toPandas()
    scores = np.interp(quality.fourier(np.stack(rows["x"].to_list()), mean, spread) @ ridge(np.ones(len(y), bool), lam), centres, values)
    return dict(zip(rows["id"], np.clip(scores, 0, 1), strict=True))


def test_scores_equal_dense_algebra(spark):
    d = "/root/testdata/sf0.01"
    described = quality.statistics(table(spark, d, "documents")).cache()
    labels = table(spark, d, "labels").filter(~fold())
    got = queries.op12_quality(spark, d).toPandas()
    want = plain(described, labels.select("doc_id", "quality"))
    assert len(got) == len(want) and np.abs(got["score"] - got["doc_id"].map(want)).max() < 1e-6
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_held_out_rows_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op12_quality(spark, d).filter("held_out").join(table(spark, d, "labels"), "doc_id").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.97
    assert (got["predicted"] == got["quality"]).mean() > 0.93 and (good >= 0.3).mean() > 0.99


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 1, 2]))
    assert x.tolist() == [0, 1.5, 3] and y.tolist() == [0, 0.5, 1]


def test_statistics_of_odd_texts(spark, odd_docs, no_docs):
    rows = quality.statistics(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(len(r["x"]) == len(quality.STATISTICS) and np.isfinite(r["x"]).all() for r in rows)
    at = dict(zip(quality.STATISTICS, quality.describe("Go GO!! go go |\ngo 12\n\ngo 12"), strict=True))
    assert at["same_as_last"] == pytest.approx(1 / 9) and at["repeated_lines"] == pytest.approx(1 / 3) and at["shouts"] == pytest.approx(2 / 19)
    assert at["uppercase"] == pytest.approx(3 / 12) and at["digits"] == pytest.approx(4 / 19) and at["number_words"] == pytest.approx(2 / 9)
    assert quality.describe(None) == quality.describe("") == [0.0] * len(quality.STATISTICS)
    assert quality.statistics(no_docs).count() == 0


def test_few_labels(spark, odd_docs, no_docs):
    """No labels, labels of one kind, of other values, of unknown and null ids; repeated labels."""
    described = quality.statistics(odd_docs)
    for rows in ([], [(1, 1), (2, 1)], [(1, None), (2, 7), (None, 1), (None, 0), (999, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = quality.score(described, quality.fit(described, labels, F.lit(True))).collect()
        assert len(got) == odd_docs.count() and len({r["score"] for r in got}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] * 2, "doc_id long, quality int")
    got = quality.score(described, quality.fit(described, labels, F.lit(True))).collect()
    assert sum(r["doc_id"] is None for r in got) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(quality.statistics(no_docs), quality.fit(described, labels, F.lit(True))).count() == 0
