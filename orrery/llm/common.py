"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole texts are worked on in groups of about so many characters; a longer text is a group of its own.
CHUNK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about `limit` characters each; every text lies in exactly one run."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) over all pairs."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(ends[-1])


def offsets(lengths) -> np.ndarray:
    """Start of each item, and the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def held_out(doc_id) -> F.Column:
    """The fold that is never learned from. A row of a null id, which has no fold, belongs to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def kept_rows(docs: DataFrame, text_col: str, decide: Callable[[list[str | None]], Sequence[bool]]) -> DataFrame:
    """The rows whose text is kept by a decision on some texts together; all columns stay as they are, and no row is moved."""
    bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(text_col).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def bounded_batches(df: DataFrame, rows: int = 1000) -> None:
    """Lets workers get at most so many rows at once: whole texts are larger than the rows that the default is meant for."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, rows)


def sampled(rows: DataFrame, n: int, id_col: str) -> DataFrame:
    """At most n rows, those whose ids have the least hashes.

    A limit on ordered rows takes n rows from every task to the driver. Rows with hashes far beyond the n-th are left out
    before, so that what the driver gets doesn't grow with the number of tasks.
    """
    total = rows.count()
    order = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    if total > 3 * n:
        rows = rows.filter(order < int(3 * n / total * (1 << 40)))
    return rows.orderBy(order, id_col).limit(n)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, as a setting or as the context's checkpoint directory.

    Where neither is set, a local run uses a folder of its own machine; a cluster, whose machines would not see each
    other's files, is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return tempfile.gettempdir() + "/orrery-checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again, which cuts its lineage; removed when Spark ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/orrery-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
