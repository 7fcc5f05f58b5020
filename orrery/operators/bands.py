"""Electronic bands: densities of states, contributions and participation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RYDBERG = 13.60568  # eV


def relative_energy(energy: Column, fermi: Column) -> Column:
    """Energy above the Fermi level, from rydberg to eV."""
    return (energy - fermi) * RYDBERG


def occupation(occ: Column) -> Column:
    """2 for doubly, 1 for singly occupied bands, 0 for others."""
    return F.when((occ > 1.5) & (occ < 2.1), 2).when((occ > 0.5) & (occ <= 1.5), 1).otherwise(0)


def selected(weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """Weights of the chosen (step, band) pairs."""
    return weights.join(chosen.select("step", "band").distinct(), ["step", "band"], "left_semi")


def kernel(width: float, bin_size: float, reach: float = 4.0) -> list[float]:
    """A Gaussian on bins up to `reach` widths away, of sum 1."""
    n = int(reach * width / bin_size)
    values = [math.exp(-0.5 * (k * bin_size / width) ** 2) for k in range(-n, n + 1)]
    return [v / sum(values) for v in values]


def broadened(rows: DataFrame, energy: Column, weight: Column, width: float = 0.04, bin_size: float = 0.005, most: int = 1000, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, dos): weights spread over bins around their energy; bins beyond +-most are dropped.

    Rows of one bin are summed before they are spread.
    """
    values = kernel(width, bin_size)
    n = len(values) // 2
    counted = rows.groupBy(*keys, F.floor(energy / bin_size + 0.5).cast("int").alias("at")).agg(F.sum(weight).alias("w"))
    spread = F.explode(F.array(*(F.struct(F.lit(k - n).alias("d"), F.lit(v).alias("v")) for k, v in enumerate(values))))
    out = counted.withColumn("s", spread).select(*keys, (F.col("at") + F.col("s.d")).alias("bin"), (F.col("w") * F.col("s.v")).alias("v"))
    return out.filter(F.abs("bin") <= most).groupBy(*keys, "bin").agg(F.sum("v").alias("dos"))


def normalized(weights: DataFrame, least: float = 0.5, keys: Sequence[str] = ("step", "band")) -> DataFrame:
    """Weights as shares of their band's sum; bands whose sum isn't above `least` are dropped."""
    total = weights.groupBy(*keys).agg(F.sum("weight").alias("total")).filter(F.col("total") > least)
    return weights.join(total, list(keys)).withColumn("weight", F.col("weight") / F.col("total")).drop("total")


def projected(weights: DataFrame, energies: DataFrame, groups: Sequence[str], width: float = 0.04, bin_size: float = 0.005, most: int = 1000) -> DataFrame:
    """(groups, bin, dos): densities of states by region, type and the like. energies: (step, band, energy)."""
    shares = normalized(weights).groupBy("step", "band", *groups).agg(F.sum("weight").alias("weight"))
    return broadened(shares.join(energies, ["step", "band"]), F.col("energy"), F.col("weight"), width, bin_size, most, groups)


def hybridisation(weights: DataFrame, by: str = "type") -> DataFrame:
    """(step, band, <by>_i, <by>_j, weight): products of kinds' shares in each band."""
    shares = normalized(weights).groupBy("step", "band", by).agg(F.sum("weight").alias("w"))
    other = shares.select("step", "band", F.col(by).alias(f"{by}_j"), F.col("w").alias("v"))
    return shares.withColumnRenamed(by, f"{by}_i").join(other, ["step", "band"]).select("step", "band", f"{by}_i", f"{by}_j", (F.col("w") * F.col("v")).alias("weight"))


def contributions(weights: DataFrame, keys: Sequence[str] = ("step", "band")) -> DataFrame:
    """(keys, atom, p): an atom's orbitals together, as a share of the band."""
    atoms = weights.groupBy(*keys, "atom").agg(F.sum("weight").alias("weight"))
    total = atoms.groupBy(*keys).agg(F.sum("weight").alias("total"))
    return atoms.join(total, list(keys)).select(*keys, "atom", F.try_divide(F.col("weight"), F.col("total")).alias("p"))


def dominated(weights: DataFrame, chosen: Column, keys: Sequence[str] = ("band",)) -> DataFrame:
    """(keys): bands in which the chosen atoms have more than half of the weight, by the sums alone, as a sum of shares is
    rounded where both halves are equal."""
    both = weights.groupBy(*keys).agg(F.sum(F.when(chosen, F.col("weight"))).alias("_some"), F.sum("weight").alias("_all"))
    return both.filter(2 * F.col("_some") > F.col("_all")).select(*keys)


def participation(shares: DataFrame, keys: Sequence[str] = ("step", "band")) -> DataFrame:
    """(keys, participation): 1 / sum p^2."""
    return shares.groupBy(*keys).agg((1 / F.sum(F.col("p") * F.col("p"))).alias("participation"))


def ranked(shares: DataFrame, keys: Sequence[str] = ("step", "band")) -> DataFrame:
    """(keys, rank, atom, p): each band's atoms by falling share, ties to smaller atoms."""
    return shares.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "atom")))
