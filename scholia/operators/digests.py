"""Digests of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digest(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """sha256 over `id TAB sha NEWLINE` in id order, with the row count.

    The lines are about 80 bytes a row and meet in one place, so this form is for tables of up to some
    ten million rows; ranged_digest has no such limit.
    """
    line = F.struct(F.col(key).alias("k"), F.concat(F.col(key).cast("string"), F.lit("\t"), F.sha2(F.col(text).cast("binary"), 256), F.lit("\n")).alias("l"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"])
    return df.agg(F.count("*").alias("rows"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")


def ranged_digest(df: DataFrame, key: str, text: str, width: int = 100_000) -> DataFrame:
    """Another rule for any size: digests of id ranges of `width`, then one over the ranges' digests."""
    part = F.floor(F.col(key) / width)
    line = F.struct(F.col(key).alias("k"), F.concat(F.col(key).cast("string"), F.lit("\t"), F.sha2(F.col(text).cast("binary"), 256), F.lit("\n")).alias("l"))
    own = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "").cast("binary"), 256).alias("d"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "").cast("binary"), 256).alias("digest"))
