"""Formats of trajectories behind one protocol: detect, probe, index, count, skip, read and filter.

A format is a small set of functions from paths to tables. Others may be added to FORMATS under a name of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .dumps import boxed, dump_pieces, read_dump, read_xyz


@dataclass(frozen=True)
class Format:
    """detect tells a format by a file's first line; index gives its frames (path, timestep, n_atoms, ...) by their headers
    alone; read gives (frames, atoms) of the asked columns."""

    name: str
    detect: Callable[[str], bool]
    index: Callable[[SparkSession, str | Sequence[str]], DataFrame]
    read: Callable[..., tuple[DataFrame, DataFrame]]

    def probe(self, spark: SparkSession, path: str | Sequence[str]) -> Row | None:
        """The first frame of the first file, None if there is none."""
        return self.index(spark, path).orderBy("path", "timestep").limit(1).first()

    def count(self, spark: SparkSession, path: str | Sequence[str]) -> int:
        """Number of whole frames; no atom is parsed."""
        return self.index(spark, path).count()

    def skip(self, spark: SparkSession, path: str | Sequence[str], frames: int) -> DataFrame:
        """The index without the first frames of each file."""
        place = F.row_number().over(Window.partitionBy("path").orderBy("timestep"))  # one row for each frame
        return self.index(spark, path).withColumn("_place", place).filter(F.col("_place") > frames).drop("_place")

    def filter(self, spark: SparkSession, path: str | Sequence[str], steps: Column | None = None, atoms: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Atoms of the frames whose time step fits, that fit themselves; frames are chosen before their atoms are parsed."""
        options = {"columns": columns} if columns else {}
        found = self.read(spark, path, where=steps, **options)[1]
        return found if atoms is None else found.filter(atoms)


def dump_index(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, timestep, n_atoms, box, pbc, header, at) of whole frames; at is the byte where the header begins."""
    return boxed(dump_pieces(spark, path), "at", "before").filter("before = 0").dropDuplicates(["path", "at"]).drop("before")


def xyz_read(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = ("element", "x", "y", "z"), where: Column | None = None, **options) -> tuple[DataFrame, DataFrame]:
    frames, atoms = read_xyz(spark, path, columns, **options)
    return (frames, atoms) if where is None else (frames.filter(where), atoms.filter(where))


FORMATS = {
    f.name: f
    for f in (
        Format("dump", lambda line: line.startswith("ITEM:"), dump_index, read_dump),
        Format("xyz", lambda line: line.strip().isdigit(), lambda spark, path: read_xyz(spark, path)[0], xyz_read),
    )
}


def detected(spark: SparkSession, path: str) -> Format:
    """The format that the first line of some file of a path tells; an unknown one is an error."""
    first = spark.read.text(path).limit(1).first()
    found = [f for f in FORMATS.values() if first and f.detect(first[0])]
    if not found:
        raise ValueError(f"no format is known for {path}")
    return found[0]
