"""Files as byte ranges: what a task reads is bounded by the range, whatever the size of a file or of a frame in it.

Spark lists the files; tasks open them by their URI through Arrow's file systems (local and shared folders, object stores,
HDFS), so only the ranges that a plan asks for are read. A record that starts in a range belongs to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in a range.
RANGE = 64 << 20
#: Stores that Arrow opens, by the scheme of the path.
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, length) of all files; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def ranged(listed: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, length, begin, end) of the files' ranges, dealt over the tasks."""
    parts = listed.filter("length > 0").withColumn("begin", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(size))))
    parts = parts.withColumn("end", F.least(F.col("begin") + size, F.col("length")))
    return parts.repartition("path", "begin")


def store_of(path: str) -> tuple:
    """Arrow's file system of a path, and the place in it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if "/" in scheme or not rest:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def sized(paths: DataFrame) -> DataFrame:
    """(path, length) of files that are named one by one (column path), looked up by tasks; a missing one is an error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            told = batch.column("path").to_pylist()
            lengths = []
            for path in told:
                system, place = store_of(path)
                size = system.get_file_info(place).size
                if size is None:
                    raise FileNotFoundError(f"{path} is no file")
                lengths.append(size)
            yield pa.RecordBatch.from_pydict({"path": pa.array(told, pa.string()), "length": pa.array(lengths, pa.int64())})

    return paths.select("path").mapInArrow(run, "path string, length long")


def qualified(spark: SparkSession, path: Column) -> Column:
    """Paths with the store that Spark takes for those that name none."""
    space = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    root, here = space.getUri().toString().rstrip("/"), space.getWorkingDirectory().toString().rstrip("/")
    root = root if "//" in root else root + "//"
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).when(path.startswith("/"), F.concat(F.lit(root), path)).otherwise(F.concat(F.lit(here + "/"), path))


def opener() -> Callable:
    """A function that opens a path, and keeps the last file open."""
    last: list = [None, None]

    def opened(path: str):
        if last[0] != path:
            system, place = store_of(path)
            if last[1] is not None:
                last[1].close()
            last[:] = path, system.open_input_file(place)
        return last[1]

    return opened


def read_at(file, begin: int, size: int) -> bytes:
    file.seek(begin)
    return file.read(size)


def line_start(file, at: int, length: int, step: int = 1 << 16) -> int:
    """Where the first line begins that begins at or behind a place."""
    if at <= 0:
        return 0
    at -= 1
    while at < length:
        data = read_at(file, at, step)
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return length


def readable(paths: Sequence[str]) -> bool:
    """Whether tasks can open these paths by range."""
    return all((p.partition(":")[0] if ":" in p.split("/")[0] else "") in SCHEMES and not p.endswith(COMPRESSED) for p in paths)


def filled_lines(data: bytes) -> int:
    """Number of lines that aren't blank."""
    if b"\n\n" not in data and b"\r" not in data and b" \n" not in data and data[:1] not in (b"\n", b" "):
        return data.count(b"\n") + (not data.endswith(b"\n") and bool(data))
    return sum(1 for x in data.split(b"\n") if x.strip())


def rows_of(batches: Iterator, names: Sequence[str]) -> Iterator[dict]:
    """Rows of Arrow batches as dicts."""
    for batch in batches:
        yield from batch.select(list(names)).to_pylist()
