"""A stored table of rows that belong to versions, replaced version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import scratch
from .stored import remove

#: The table is split by a hash of the version; a replacement rewrites the parts of its versions only.
BUCKETS = 32


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, mode: str, order: list[str]) -> None:
    # by ranges, so that a version that holds most rows is written by many tasks
    rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_versions(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """A new table; `order` (which starts with the key) is how rows are sorted in it."""
    _write(rows.withColumn("bucket", _bucket(key)), path, "overwrite", order)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replace_versions(spark: SparkSession, path: str, fresh: DataFrame, versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows of the given versions (a column `key`) become those in fresh; a version without fresh rows loses all.

    Fresh rows of other versions are an error.  Only parts that hold the versions are rewritten, from
    a copy in the shared folder, so a repetition after a failure (or without one) gives the same rows.
    Returns (bucket, rows) of what was written.
    """
    versions = versions.select(key).distinct()
    if not fresh.join(versions, key, "left_anti").isEmpty():
        raise ValueError("fresh rows of versions that are not replaced")
    touched = sorted(r[0] for r in versions.select(_bucket(key).alias("b")).distinct().collect())  # BUCKETS at most
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(versions, key, "left_anti")
    copy = scratch(spark)
    old.unionByName(fresh.withColumn("bucket", _bucket(key))).write.parquet(copy)
    merged = spark.read.parquet(copy)
    kept = {r["bucket"]: r["count"] for r in merged.groupBy("bucket").count().collect()}
    if kept:
        _write(merged, path, "overwrite", order)
    for bucket in set(touched) - set(kept):
        remove(spark, f"{path}/bucket={bucket}")
    return spark.createDataFrame([(b, kept.get(b, 0)) for b in touched], "bucket int, rows long")
