"""Statistics of paired and repeated measurements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import numbered

Z_95 = 1.959964
#: Draws of a bootstrap that are in memory at once.
DRAWS = 1 << 20


def wilson(hits: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson interval; (0, 1) without trials."""
    p = hits / F.nullif(n, F.lit(0))
    scale = 1 + z * z / F.nullif(n, F.lit(0))
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.coalesce((middle - half) / scale, F.lit(0.0)), F.coalesce((middle + half) / scale, F.lit(1.0))


def exact_binomial(a: Column, b: Column) -> Column:
    """Two-sided exact sign test of a against b at one half; 1 without discordant pairs."""
    n, low = a + b, F.least(a, b)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, k: F.struct((s["term"] * (n - k) / (k + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low.cast("long")), start, step, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)))


def cohen_kappa(both: Column, neither: Column, first: Column, second: Column, n: Column) -> Column:
    """Agreement beyond chance of two yes/no raters; 1 where chance alone agrees always."""
    seen = (both + neither) / n
    chance = (first / n) * (second / n) + (1 - first / n) * (1 - second / n)
    return F.when(chance == 1, F.lit(1.0)).otherwise((seen - chance) / (1 - chance))


def bootstrap_draws(seed: int, families: int, resamples: int) -> np.ndarray:
    """Row r: the families drawn in resample r."""
    return np.random.default_rng(seed).integers(0, families, (resamples, families))


def resampled(units: DataFrame, order: list[str], values: list[str], seed: int, resamples: int = 1000, piece: int = DRAWS) -> tuple[DataFrame, int]:
    """(replicate, sums of values) over as many units, drawn with replacement as bootstrap_draws() does; and the number of units.

    Units are numbered in the given order.  Each task holds a range of them, runs through the same
    stream of draws a piece at a time, and sums what it holds for each replicate; tasks give a row
    for each replicate.  Nothing that grows with the units is on the driver or in a broadcast.
    """
    placed = numbered(units.select(*order, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]), *order, name="_unit")
    count = placed.count()
    names = [f"s{k}" for k in range(len(values))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(p.column(0).to_numpy(), *(p.column(1 + k).to_numpy() for k in range(len(values)))) for p in parts if p.num_rows]
        if not held:
            return
        at, *own = (np.concatenate(x) for x in zip(*held, strict=True))
        low = int(at.min())
        table = np.zeros((len(values), int(at.max()) - low + 1))
        for k, v in enumerate(own):
            table[k, at - low] = v
        rng, sums = np.random.default_rng(seed), np.zeros((resamples, len(values)))
        for r in range(resamples):
            for start in range(0, count, piece):
                drawn = rng.integers(0, count, min(piece, count - start)) - low
                drawn = drawn[(drawn >= 0) & (drawn < table.shape[1])]
                sums[r] += table[:, drawn].sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int64()), *(pa.array(x) for x in sums.T)], names=["replicate", *names])

    # contiguous numbers in each task: the rows come in the order of one range shuffle
    ranged = placed.select("_unit", *values).repartitionByRange("_unit")
    found = ranged.mapInArrow(run, "replicate long, " + ", ".join(f"{n} double" for n in names))
    return found.groupBy("replicate").agg(*[F.sum(n).alias(v) for n, v in zip(names, values, strict=True)]), count


def percentile_interval(replicates: DataFrame, value: Column, tail: float = 2.5) -> DataFrame:
    """(low, high): linear percentiles of a value of each replicate; one row of as many values as there are resamples."""
    return replicates.agg(F.percentile(value, tail / 100).alias("low"), F.percentile(value, 1 - tail / 100).alias("high"))


def family_bootstrap(values: DataFrame, family: str, value: str, seed: int = 20240601, resamples: int = 1000) -> DataFrame:
    """(mean, low, high, families): the mean of family means with its percentile interval; families are ordered by name."""
    means = values.groupBy(family).agg(F.avg(value).alias("m")).where("m is not null")
    replicates, count = resampled(means, [family], ["m"], seed, resamples)
    interval = percentile_interval(replicates, F.col("m") / F.lit(max(count, 1)))
    return means.agg(F.avg("m").alias("mean"), F.count("*").alias("families")).crossJoin(interval).select("mean", "low", "high", "families")  # one row each


def rate_bootstrap(groups: DataFrame, order: list[str], first: tuple[str, str], second: tuple[str, str], seed: int = 0, resamples: int = 1000) -> DataFrame:
    """(low, high, groups): interval of the difference of two rates (hits, trials), groups resampled and items averaged; a rate without trials is 0."""
    replicates, count = resampled(groups, order, [*first, *second], seed, resamples)
    rate = lambda hits, n: F.col(hits) / F.greatest(F.col(n), F.lit(1.0))
    return percentile_interval(replicates, rate(*first) - rate(*second)).withColumn("groups", F.lit(count).cast("long"))
