"""Row numbers and order statistics of a whole table or of groups of any size.

Rows are sorted by one range shuffle; what precedes a partition is a sum over partition totals, of
which there are as many as partitions.  No group has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import scratch


def _cut(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with each row's number, from 0, in the order of the given columns; rows equal in all of them are numbered in any order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    ranged = _cut(ranged.withColumn("_part", F.shiftright("_seq", 33)).withColumn(name, F.col("_seq").bitwiseAND((1 << 33) - 1)).drop("_seq"))
    before, total = [], 0
    for r in ranged.groupBy("_part").count().orderBy("_part").toLocalIterator():
        before.append((r["_part"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    # a row for each partition of the shuffle
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def every_nth(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows at positions 0, step, 2 * step, ... in key order, n at most; step is the row count over n, rounded down."""
    keys = numbered(df.select(key), key)
    total = keys.count()
    step = max(1, total // max(1, n))
    chosen = keys.where((F.col("position") % step == 0) & (F.col("position") < step * n))
    return df.join(F.broadcast(chosen.select(key)), key, "left_semi")  # n keys at most


def ranges(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, low, high, total): each distinct value of a group holds the places low to high - 1 of its sorted values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    ranged = _cut(counted.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()))
    own = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_own"))
    whole = Window.partitionBy(*groups)
    own = own.withColumn("total", F.sum("_own").over(whole)).withColumn("_before", F.sum("_own").over(whole.orderBy("_part")) - F.col("_own"))
    here = Window.partitionBy(*groups, "_part").orderBy(value)
    placed = ranged.withColumn("_high", F.sum("_n").over(here))
    same = [placed[c].eqNullSafe(own[c]) for c in groups]
    joined = placed.join(own, [placed["_part"] == own["_part"], *same])
    high = F.col("_before") + F.col("_high")
    return joined.select(*[placed[c] for c in groups], placed[value], (high - F.col("_n")).alias("low"), high.alias("high"), "total")


def order_statistics(df: DataFrame, groups: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """A row for each group with the wanted quantiles: name -> (share, rule).

    Rules: `index` takes the sorted value at floor(share * n), the last at most; `linear` goes
    between the two values around share * (n - 1).  Null values do not count; a group without any
    other has no row.
    """
    placed = ranges(df, groups, value)
    at = lambda place: F.max(F.when((F.col("low") <= place) & (place < F.col("high")), F.col(value)))
    aggregates: list[Column] = []
    for name, (share, rule) in wanted.items():
        if rule == "index":
            aggregates.append(at(F.least(F.floor(F.lit(float(share)) * F.col("total")), F.col("total") - 1)).alias(name))
        else:
            place = F.lit(float(share)) * (F.col("total") - 1)
            low, high = at(F.floor(place)).cast("double"), at(F.ceil(place)).cast("double")
            part = F.max(place - F.floor(place))
            aggregates.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*groups).agg(*aggregates)
