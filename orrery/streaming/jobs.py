"""Streams of dumps to voxels, of samples to averages, and of results to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import DEBYE
from ..operators.tables import latest
from ..operators.voxels import voxel_fields
from ..sources.dumps import read_dump
from ..sources.ranges import RANGE

SAMPLE = "traj_id long, step long, mx double, my double, mz double"


def stream_voxels(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, size: float, lengths: Sequence[float], mass: Column):
    """Voxel rows of each batch of new frames, appended once; a frame arrives whole. Gives the started query."""
    frames = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces what it wrote before
        voxel_fields(batch, size, lengths, mass).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_sums(terms, ends, counts, size: int):
    """Sums of the `counts` rows before each end, size at most; windows of fewer begin at row 0.

    Rows are summed within blocks of `size`, from either end, and a window is the end of one block and the beginning of the
    next, so that its digits don't depend on how many samples came before.
    """
    import numpy as np

    blocks = np.concatenate([terms, np.zeros((-len(terms) % size, terms.shape[1]))]).reshape(-1, size, terms.shape[1])
    down = np.cumsum(blocks, 1).reshape(-1, terms.shape[1])
    up = np.cumsum(blocks[:, ::-1], 1)[:, ::-1].reshape(-1, terms.shape[1])
    first = ends - counts
    return down[ends - 1] + np.where((first // size != (ends - 1) // size)[:, None], up[np.minimum(first, len(up) - 1)] if len(up) else 0.0, 0.0)


def running_averages(samples: DataFrame, strategy: str, size: int) -> DataFrame:
    """(traj_id, step, m2, mm, variance, debye2) as samples arrive, with state for each trajectory.

    strategy: binned, each `size` samples on their own; sliding, the last `size` at each step; cumulative, all so far;
    hybrid, cumulative until there are `size`, then sliding. The state is the number of samples, the last step, six sums
    and, but for cumulative, the samples of the window. Samples of a trajectory must arrive in the order of their steps;
    one that comes before what was seen is an error.
    """
    import numpy as np
    import pandas as pd

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, last, before, held = state.get if state.exists else (0, None, bytes(48), b"")
        new = pd.concat(list(batches)).sort_values("step", kind="stable")
        if last is not None and len(new) and new["step"].iloc[0] < last:
            raise ValueError(f"trajectory {key[0]}: step {new['step'].iloc[0]} comes after step {last}")
        old = np.frombuffer(held).reshape(-1, 3)
        m = new[["mx", "my", "mz"]].to_numpy(float)
        every = np.concatenate([old, m])
        terms = np.concatenate([every, every * every], 1)
        at = len(old) + 1 + np.arange(len(m))  # places behind each new sample
        number = seen + 1 + np.arange(len(m))
        if strategy == "cumulative":
            sums = np.concatenate([np.zeros((1, 6)), np.cumsum(terms, 0)])
            total, n, shown = np.frombuffer(before) + sums[at], number, np.ones(len(m), bool)
        elif strategy == "binned":
            n, shown = np.full(len(m), size), number % size == 0
            total = window_sums(terms, at, np.minimum(at, size), size)
        else:
            n = np.minimum(number, size)
            total, shown = window_sums(terms, at, n, size), number >= size if strategy == "sliding" else np.ones(len(m), bool)
        mean = total[shown] / n[shown, None]
        m2, mm = mean[:, 3:].sum(1) / 3, (mean[:, :3] ** 2).sum(1) / 3
        if len(m):
            before = (np.frombuffer(before) + sums[-1]).tobytes() if strategy == "cumulative" else before
            held = b"" if strategy == "cumulative" else np.ascontiguousarray(every[-size:]).tobytes()
            state.update((int(number[-1]), int(new["step"].iloc[-1]), before, held))
        yield pd.DataFrame({"traj_id": key[0], "step": new["step"].to_numpy()[shown], "m2": m2, "mm": mm, "variance": m2 - mm, "debye2": (m2 - mm) * DEBYE * DEBYE})

    return samples.groupBy("traj_id").applyInPandasWithState(update, "traj_id long, step long, m2 double, mm double, variance double, debye2 double", "seen long, last long, sums binary, held binary", "append", "NoTimeout")


def running_bins(samples: DataFrame, size: int) -> DataFrame:
    """Every full bin of `size` samples."""
    return running_averages(samples, "binned", size)


def stream_dumps(spark: SparkSession, folder: str, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], columns: Sequence[str] = ("atom_id", "type", "x", "y", "z"), size: int = RANGE):
    """What `process` makes of the atoms (path, timestep, <columns>) of new dump files, once for each. Gives the started query.

    The stream's offsets are the files' names: a file is read in the batch in which it is seen first, by byte ranges, and
    a query that is started again goes on behind the files of the last batch. The result must have a column timestep; it
    is stored by time step, and a batch that is tried again replaces the steps that it wrote before.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "length")

    def write(batch: DataFrame, number: int) -> None:
        _, atoms = read_dump(batch.sparkSession, batch, columns, size=size)
        process(atoms).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timestep").parquet(target)

    return names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_results(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, keys: Sequence[str], version: str | None = None):
    """Result rows of each batch appended to a log of results by batch. Gives the started query.

    Of rows of one key in a batch the last one stays: that of the greatest `version`, a column that is carried along, or
    else the one of the newest file, and the last in it. A batch writes its own rows alone, and one that is tried again
    replaces what it wrote before; `current` gives the last row of each key.
    """
    rows = spark.readStream.schema(schema).json(source)
    told = {"_time": "file_modification_time", "_path": "file_path", "_block": "file_block_start"}
    rows = rows.select("*", *(F.col(f"_metadata.{c}").alias(n) for n, c in told.items()))

    def write(batch: DataFrame, number: int) -> None:
        order = F.struct(*([F.col(version)] if version else []), *told, "_number")
        numbered = batch.withColumn("_number", F.monotonically_increasing_id())
        kept = numbered.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in batch.columns if c not in told)), order).alias("_row"))
        kept.select("_row.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """The table that a log of results tells: of each key the row of the greatest version, if one is kept, and else of its last batch."""
    order = F.struct(*([F.col(version)] if version else []), "batch")
    return latest(spark.read.parquet(target).withColumn("_order", order), keys, "_order").drop("batch", "_order")


def compacted(spark: SparkSession, target: str, keys: Sequence[str], to: str, version: str | None = None) -> None:
    """A new log with one batch, the last of the old one, that tells the same table; a stream may go on writing to it."""
    last = spark.read.parquet(target).agg(F.max("batch")).first()[0]
    current(spark, target, keys, version).write.parquet(f"{to}/batch={last or 0}")


def windowed_steps(samples: DataFrame, dt: float, seconds: int, late: int) -> DataFrame:
    """Means over windows of simulated time: step times dt seconds is the event time.

    In append mode a window is given once the watermark, `late` seconds behind the newest sample, has passed its end; its
    state goes then, and samples that come later are dropped, and counted by `dropped`.
    """
    timed = samples.withColumn("at", F.timestamp_seconds(F.col("step") * dt)).withWatermark("at", f"{late} seconds")
    return timed.groupBy("traj_id", F.window("at", f"{seconds} seconds")).agg(F.count("*").alias("n"), *(F.avg(f"m{a}").alias(f"m{a}") for a in "xyz"))


def dropped(query) -> int:
    """Groups of late rows that a stream's watermark has dropped, by its own report."""
    return sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)


def kept_state(query) -> int:
    """Groups that a stream holds after its last batch."""
    return sum(int(o.numRowsTotal) for o in query.lastProgress.stateOperators)
