"""Hard negatives of anchors by a vertical scan of columnar blocks (BOND).

Vectors become whole numbers, so scores are exact. They lie in blocks, one row of the matrix for each dimension, with the
least and the greatest component of every dimension. An anchor reads the dimensions of a block in the order of its own
descending magnitudes, a few at a time. After each step the partial scores and the least and greatest that the remaining
dimensions can add bound every candidate's score; candidates that the bounds rule out leave the bitmap, and only what stays
is read further. What stays to the end has its exact score.

1. Among rows of the anchor's label, a candidate is out once k others are sure to score higher: its positives.
2. Among rows of other labels, each positive's score gives a window. A candidate is out of a window once its score is sure
   to lie outside or k others are sure to lie inside and higher; out of all windows it leaves the bitmap.

Blocks of anchors meet blocks of vectors, each pair one row of work, so any number of anchors is met. Blocks give their k
best of each anchor or window, and only those are ranked in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .topk import NONE, beside, blocks, dealt, matrix, named, numbers, usable, whole

#: Vectors in a block, and dimensions that are read together.
BLOCK, STEP = 4096, 8

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def exact_type(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> type:
    """The fastest kind of numbers that holds every sum of products: doubles, 64-bit numbers, or Python's own."""
    most = sum(abs(int(a)) * max(abs(int(x)), abs(int(y))) for a, x, y in zip(q, low, high, strict=True))
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def vertical(q: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, bitmap: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates of the bitmap that stay; keep tells which may, by bounds of their scores.

    columns: one row a dimension, in a kind of numbers that holds all sums; low and high are their least and greatest.
    """
    kind = columns.dtype
    q, low, high = q.astype(kind), low.astype(kind), high.astype(kind)
    order = np.argsort(-np.abs(q), kind="stable")
    least, most = np.minimum(q * low, q * high)[order], np.maximum(q * low, q * high)[order]
    at = np.flatnonzero(bitmap)
    score = np.zeros(len(at), kind)
    for k in range(0, len(order), STEP):
        if not len(at):
            break
        read = order[k : k + STEP]
        score = score + q[read] @ (columns[read] if len(at) == columns.shape[1] else columns[np.ix_(read, at)])
        stay = keep(score + least[k + STEP :].sum(), score + most[k + STEP :].sum())
        at, score = at[stay], score[stay]
    if kind == object and len(score) and max(abs(int(x)) for x in score) >= 1 << 62:
        raise OverflowError("a score doesn't fit into 64 bits")
    return at, score.astype(np.int64)


def among_best(k: int) -> Keep:
    """Those that fewer than k others are sure to beat."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, -k)[-k] if len(low) > k else np.ones(len(low), bool)

    return keep


def in_windows(windows: list[tuple[int, int]], k: int) -> Keep:
    """Those that may be among the k best of a window (both ends belong to it)."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for first, last in windows:
            may = (high >= first) & (low <= last)
            sure = low[(low >= first) & (high <= last)]
            if len(sure) > k:
                may &= high >= np.partition(sure, -k)[-k]
            stay |= may
        return stay

    return keep


def window_of(positive: int, least: int = 80, most: int = 100) -> tuple[int, int]:
    """Least and greatest whole score s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


def best(score: np.ndarray, vec: np.ndarray, unnamed: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        high = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return high[best(score[high], vec[high], unnamed[high], key[high], k)] if len(high) < len(score) else np.lexsort((key, unnamed, vec, -score))[:k]
    return np.lexsort((key, unnamed, vec, -score))[:k]


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's hard negatives.

    An anchor's positives are its first rows of the same label; the negatives of a positive are the first rows of another
    label that score from least to most percent of the positive. Ties go to smaller ids, a null id behind all others.
    Rows with a null label, a null or empty vector or a null or non-finite component take no part; vectors of other
    lengths are never compared. Rows that repeat an id are rows of their own, also to each other. Fewer rows than asked
    for give all of them. An empty table gives an empty result. Columns other than those named or read by the expressions
    don't matter. A score that doesn't fit into 64 bits is an error.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # whatever the two expressions read is read before columns get names of their own
    rows = vectors.select(F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), label.cast("long").alias("label"), *(c.alias(n) for n, c in named(id_col).items()))
    rows = rows.filter(usable(F.col("v")) & (F.size("v") > 0) & F.col("label").isNotNull())
    rows = stored(rows.withColumn("v", whole(F.col("v"))).withColumn("key", F.monotonically_increasing_id()))
    keep = ["key", "vec", "unnamed", "label"]
    candidates = dealt(blocks(rows, BLOCK, keep=keep), parts)
    anchors = rows.filter("asked").drop("asked")

    def scanned(batches: Iterator[pa.RecordBatch], scan: Callable[..., Iterator[tuple]], fields: dict[str, np.dtype]) -> Iterator[pa.RecordBatch]:
        """What a scan gives for each anchor of each pair of blocks; columns are laid out once a block and kind of number."""
        for batch in batches:
            for row in batch.to_pylist():
                block = {c: numbers(row[c]) for c in keep}
                asking = {c: numbers(row[f"q_{c}"]) for c in (c[2:] for c in row if c.startswith("q_") and c != "q_matrix")}
                columns_ = np.ascontiguousarray(matrix(row["matrix"], len(block["key"]), row["dimension"]).T)
                queries = matrix(row["q_matrix"], len(asking["key"]), row["dimension"])
                low, high = columns_.min(1), columns_.max(1)
                laid: dict[type, np.ndarray] = {}
                found: list[tuple] = []
                for n, q in enumerate(queries):
                    kind = exact_type(q, low, high)
                    if kind not in laid:
                        laid[kind] = columns_.astype(kind)
                    found += scan(q, (laid[kind], low, high), block, {c: int(x[n]) for c, x in asking.items()})
                columns = list(zip(*found, strict=True)) or [[] for _ in fields]
                yield pa.RecordBatch.from_pydict({c: pa.array(np.asarray(x, np.int64)) for c, x in zip(fields, columns, strict=True)})

    def same_label(q: np.ndarray, columns: tuple, block: dict, anchor: dict) -> list[tuple]:
        at, score = vertical(q, *columns, (block["label"] == anchor["label"]) & (block["key"] != anchor["key"]), among_best(positives))
        at_best = best(score, *(block[c][at] for c in ("vec", "unnamed", "key")), positives)
        return [(anchor["key"], *(int(block[c][at[i]]) for c in ("vec", "unnamed", "key")), int(score[i])) for i in at_best]

    def other_label(q: np.ndarray, columns: tuple, block: dict, anchor: dict) -> list[tuple]:
        windows = {r: window_of(anchor[f"s{r}"], least, most) for r in range(1, positives + 1) if anchor[f"s{r}"] != NONE}
        at, score = vertical(q, *columns, block["label"] != anchor["label"], in_windows(list(windows.values()), negatives))
        out = []
        for r, (first, last) in windows.items():
            inside = np.flatnonzero((score >= first) & (score <= last))
            where = at[inside]
            for i in best(score[inside], *(block[c][where] for c in ("vec", "unnamed", "key")), negatives):
                out.append((anchor["key"], r, *(int(block[c][where[i]]) for c in ("vec", "unnamed", "key")), int(score[inside[i]])))
        return out

    def scan(paired: DataFrame, kernel: Callable[..., list[tuple]], fields: list[str]) -> DataFrame:
        return paired.mapInArrow(lambda batches: scanned(batches, kernel, fields), ", ".join(f"{c} long" for c in fields))

    order = [F.desc("score"), F.col("vec"), F.col("unnamed"), F.col("key")]
    near = scan(beside(anchors, candidates, parts, keep), same_label, ["anchor", "vec", "unnamed", "key", "score"])
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).filter(F.col("r") <= positives)
    near = stored(near)

    scores = near.groupBy(F.col("anchor").alias("key")).agg(*(F.coalesce(F.max(F.when(F.col("r") == r, F.col("score"))), F.lit(NONE)).alias(f"s{r}") for r in range(1, positives + 1)))
    asked = anchors.join(scores, "key")
    far = scan(beside(asked, candidates, parts, [*keep, *(f"s{r}" for r in range(1, positives + 1))]), other_label, ["anchor", "r", "vec", "unnamed", "key", "score"])
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "r").orderBy(*order))).filter(F.col("rank") <= negatives)

    def name(prefix: str) -> Column:
        return F.when(F.col(f"{prefix}_unnamed") == 0, F.col(f"{prefix}_vec")).alias(f"{prefix}_id")

    far = far.select("anchor", "r", "rank", F.col("vec").alias("negative_vec"), F.col("unnamed").alias("negative_unnamed"), F.col("score").alias("negative_score"))
    near = near.select("anchor", "r", F.col("vec").alias("positive_vec"), F.col("unnamed").alias("positive_unnamed"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("key").alias("anchor"), F.col("vec").alias("anchor_vec"), F.col("unnamed").alias("anchor_unnamed"))
    return far.join(near.hint("merge"), ["anchor", "r"]).join(ids.hint("merge"), "anchor").select(name("anchor"), name("positive"), "rank", name("negative"), "positive_score", "negative_score")


ORACLE = """
    with usable as (select row_number() over () as key, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
            list_transform(embedding, lambda x: cast(floor(256e0 * cast(x as double)) as bigint)) as v
        from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.key as anchor, a.vec_id as anchor_id, c.key, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.v::double[], c.v::double[]) as bigint) as score
        from usable a join usable c on a.vec_id % 100 = 0 and c.key <> a.key and len(c.v) = len(a.v)),
    positives as (select * from (select *, row_number() over (partition by anchor order by score desc, vec_id, key) as r from scored where same) where r <= 5),
    negatives as (select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
            row_number() over (partition by p.anchor, p.r order by n.score desc, n.vec_id, n.key) as rank
        from positives p join scored n on n.anchor = p.anchor and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
    select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negatives where rank <= 5
"""
