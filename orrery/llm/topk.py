"""Exact top-k by inner product over lists of local scores, in three phases with a uniform threshold.

Vectors become whole numbers, so scores are exact. The dimensions are cut into LISTS slices; for a query, each slice has
a list of local scores, one of each vector, and a score is the sum of a vector's local scores. Vectors are packed into
blocks, queries too, and each pair of blocks is one row of work, so any number of queries is met. A block holds all
lists of its vectors, so what a phase collects is added up where it lies, and only whole scores are shuffled.

1. Each block's lists give their k highest local scores of a query. The vectors that they belong to are scored whole, and
   the k-th of all these scores is a safe cutoff: no answer lies below it.
2. The cutoff divided by the number of lists goes back to all lists. A vector that stays below it in each of them can't
   reach the cutoff, so only entries at or above this uniform threshold are collected.
3. The collected vectors are scored whole, and those that reach the cutoff are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors and queries in a block, and slices of the dimensions.
BLOCK, QUERY_BLOCK, LISTS = 1024, 256, 2
#: No cutoff: fewer than k candidates were scored.
NONE = -(1 << 63)
#: Stands for a null id, which comes behind all others.
GREATEST = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exact: in doubles or 64-bit numbers where these hold them."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    most = q.shape[1]
    for x in (q, v):
        most *= max(abs(int(x.min())), abs(int(x.max())))
    if most < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return q @ v.T
    found = q.astype(object) @ v.astype(object).T
    if max(abs(int(found.min())), abs(int(found.max()))) >= 1 << 62:
        raise OverflowError("a score doesn't fit into 64 bits")
    return found.astype(np.int64)


def blocks(rows: DataFrame, size: int, prefix: str = "", keep: Sequence[str] = ("key", "vec", "unnamed", "cutoff")) -> DataFrame:
    """Vectors v of one dimension packed together with their numbers, whatever their order; a vector is whole in one block.

    The columns to keep are 64-bit numbers without nulls; they go through Arrow as they are. Components take as few bytes
    as the block's greatest needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dimension in np.unique(lengths):
                at = np.flatnonzero(lengths == dimension)
                for k in range(0, len(at), size):
                    piece = batch.take(pa.array(at[k : k + size]))
                    packed = {"matrix": narrow(piece.column("v").flatten().to_numpy(zero_copy_only=False))}
                    packed |= {c: piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keep}
                    packed = {c: pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()}
                    yield pa.RecordBatch.from_pydict({"dimension": pa.array([dimension], pa.int32()), **packed})

    packed = rows.select("v", *keep).mapInArrow(run, ", ".join(["dimension int", *(f"{c} binary" for c in ("matrix", *keep))]))
    return packed.withColumnsRenamed({c: prefix + c for c in ("matrix", *keep)})


def beside(queries: DataFrame, candidates: DataFrame, parts: int, keep: Sequence[str]) -> DataFrame:
    """Each block of queries, whose columns begin with q_, beside each block of candidates; every part meets all query blocks.

    Neither side is broadcast: the planner takes a packed block for a short row, and would send whole tables by the driver.
    """
    packed = blocks(queries.repartition(max(1, parts // 4)), QUERY_BLOCK, "q_", keep)
    return packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge").join(candidates.hint("merge"), ["dimension", "part"])


def dealt(packed: DataFrame, parts: int) -> DataFrame:
    """Blocks with the part that each belongs to."""
    return packed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))


def named(id_col: str) -> dict[str, Column]:
    """An id as a number without nulls, which the greatest stands for, and 1 beside those."""
    number = F.col(id_col).cast("long")
    return {"vec": F.coalesce(number, F.lit(GREATEST)), "unnamed": number.isNull().cast("long")}


def numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them all."""
    ends = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max))


def matrix(raw: bytes, rows: int, dimension: int) -> np.ndarray:
    """A block's components, whatever their bytes."""
    return np.frombuffer(raw, f"i{len(raw) // (rows * dimension)}").astype(np.int64).reshape(rows, dimension)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among all other rows, ties to smaller ids.

    Null and empty vectors and those with null or non-finite components take no part; vectors of other lengths are never
    compared. Rows that repeat an id are queries and candidates each, also of each other; of equal scores and ids either
    may come first. A null id comes behind all others; a row of a null id that is_query asks for is a query of that id. Fewer than k candidates give all of them. An empty table gives an empty result. Columns other than
    the two named, and those is_query reads, don't matter. A score that doesn't fit into 64 bits is an error.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = ["key", "vec", "unnamed", "cutoff"]
    rows = vectors.select(F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"), *(c.alias(n) for n, c in named(id_col).items())).filter(usable(F.col("v")) & (F.size("v") > 0))
    # a row is called by a number that is fixed by writing it
    rows = stored(rows.withColumn("v", whole(F.col("v"))).withColumn("key", F.monotonically_increasing_id()))
    asked = rows.filter("asked").drop("asked")
    candidates = dealt(blocks(rows, BLOCK, keep=keep[:3]), parts)

    def lists(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Keys of the queries and of the vectors, and each list's local scores of all pairs of both."""
        asking, keys = numbers(row["q_key"]), numbers(row["key"])
        q, v = (np.array_split(matrix(m, len(n), row["dimension"]), LISTS, axis=1) for m, n in ((row["q_matrix"], asking), (row["matrix"], keys)))
        return asking, keys, [products(a, b) for a, b in zip(q, v, strict=True)]

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole scores of the vectors that a list of a block has among its k highest."""
        for batch in batches:
            for row in batch.to_pylist():
                asking, keys, local = lists(row)
                take = min(len(keys), k + 1)  # one may be the query itself
                among = np.zeros((len(asking), len(keys)), bool)
                for scores in local:
                    np.put_along_axis(among, np.argpartition(-scores, take - 1, axis=1)[:, :take], True, axis=1)
                among &= keys[None, :] != asking[:, None]
                where, which = np.nonzero(among)
                yield pa.RecordBatch.from_pydict({"query": asking[where], "score": sum(scores[where, which] for scores in local)})

    order = Window.partitionBy("query").orderBy(F.desc("score"))
    first = beside(asked.withColumn("cutoff", F.lit(NONE)), candidates, parts, keep).mapInArrow(highest, "query long, score long")
    ranked = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    cutoffs = ranked.groupBy(F.col("query").alias("key")).agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    again = asked.join(cutoffs, "key", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NONE)))

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors with an entry at or above the threshold in some list, whose whole score reaches the cutoff."""
        for batch in batches:
            for row in batch.to_pylist():
                asking, keys, local = lists(row)
                cutoff = numbers(row["q_cutoff"])
                threshold = cutoff // LISTS + (cutoff % LISTS > 0)  # rounded up
                entry = np.zeros((len(asking), len(keys)), bool)
                for scores in local:
                    entry |= scores >= threshold[:, None]
                entry &= keys[None, :] != asking[:, None]
                where, which = np.nonzero(entry)
                total = sum(scores[where, which] for scores in local)
                reach = total >= cutoff[where]
                where, which, total = where[reach], which[reach], total[reach]
                vec, unnamed = numbers(row["vec"])[which], numbers(row["unnamed"])[which]
                at = np.lexsort((keys[which], unnamed, vec, -total, where))
                begins = np.searchsorted(where[at], where[at])  # where each query's rows begin
                at = at[np.arange(len(at)) - begins < k]
                here = where[at]
                asker = {"query": asking[here], "query_id": numbers(row["q_vec"])[here], "query_unnamed": numbers(row["q_unnamed"])[here]}
                yield pa.RecordBatch.from_pydict(asker | {"vec": vec[at], "unnamed": unnamed[at], "key": keys[which][at], "score": total[at]})

    found = beside(again, candidates, parts, keep).mapInArrow(collected, "query long, query_id long, query_unnamed long, vec long, unnamed long, key long, score long")
    last = Window.partitionBy("query").orderBy(F.desc("score"), "vec", "unnamed", "key")
    found = found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return found.select(F.when(F.col("query_unnamed") == 0, F.col("query_id")).alias("query_id"), "rank", F.when(F.col("unnamed") == 0, F.col("vec")).alias("vec_id"), "score")


ORACLE = """
    with usable as (select row_number() over () as key, vec_id, list_transform(embedding, lambda x: cast(floor(256e0 * cast(x as double)) as bigint)) as v from embeddings
        where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select q.key, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v::double[], c.v::double[]) as bigint) as score
        from usable q join usable c on q.vec_id % 50 = 0 and c.key <> q.key and len(c.v) = len(q.v))
    select query_id, cast(rank as integer) as rank, vec_id, score
    from (select *, row_number() over (partition by key order by score desc, vec_id) as rank from scored) where rank <= 5
"""
