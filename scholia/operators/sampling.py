"""Stratified samples with a quota for each document, walked round-robin over the strata.

Each stratum has an order of its own: by a digest of seed, stratum and id.  A walk takes at most the
wanted number of rows, and passes over a row only if its document is full; so of each stratum and
document only the first `quota` rows can be taken, and of each stratum only as many of these as the
walk takes and passes over.  That much (strata times twice the sample) goes to the driver, whatever
the input; the rest is windows with limits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(seed: str):
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col("stratum").cast("string"), F.col("id").cast("string")).cast("binary"), 256)


def candidates(rows: DataFrame, seed: str, wanted: int, quota: int) -> DataFrame:
    """The rows (id, stratum, document) that a walk for `wanted` rows can come to, with their place in their stratum."""
    keyed = rows.select("id", "stratum", "document", _order(seed).alias("key"))
    few = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("stratum", "document").orderBy("key", "id"))).where(F.col("_n") <= quota)
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("key", "id")))
    return placed.where(F.col("place") <= 2 * wanted).drop("_n", "key")


def walk(queues: dict, roles: Iterable[tuple[str, int]], quota: int) -> dict:
    """id -> role, one row of each stratum in turn; roles are filled one after another."""
    order = sorted(queues, key=lambda s: (s is None, s))
    at, taken, out = dict.fromkeys(order, 0), Counter(), {}
    for role, wanted in roles:
        filled, open_ = 0, list(order)
        while filled < wanted and open_:
            for stratum in list(open_):
                queue = queues[stratum]
                while at[stratum] < len(queue) and taken[queue[at[stratum]][1]] >= quota:
                    at[stratum] += 1
                if at[stratum] == len(queue):
                    open_.remove(stratum)
                elif filled < wanted:
                    row, document = queue[at[stratum]]
                    at[stratum] += 1
                    taken[document] += 1
                    out[row] = role
                    filled += 1
    return out


def sample(rows: DataFrame, seed: str, roles: list[tuple[str, int]], quota: int) -> dict:
    """id -> role of the sampled rows of (id, stratum, document)."""
    if quota < 1 or any(n < 0 for _, n in roles):
        raise ValueError("a sample needs a quota and sizes of at least nothing")
    queues: dict = {}
    for r in candidates(rows, seed, sum(n for _, n in roles), quota).orderBy("stratum", "place").collect():
        queues.setdefault(r["stratum"], []).append((r["id"], r["document"]))
    return walk(queues, roles, quota)


def _roles(rows: DataFrame, chosen: dict) -> DataFrame:
    """rows with their role; as many chosen rows as the sample has are broadcast."""
    kind = rows.schema["id"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(sorted(chosen.items()), f"id {kind}, role string")
    return rows.join(F.broadcast(table), "id", "left")


def assigned(rows: DataFrame, seed: int, frozen: int, development: int, quota: int) -> DataFrame:
    """rows (id, stratum, document) with a role: frozen first, then development, and retrieval_only."""
    chosen = sample(rows, str(seed), [("frozen", frozen), ("development", development)], quota)
    return _roles(rows, chosen).withColumn("role", F.coalesce("role", F.lit("retrieval_only")))


def second_sample(rows: DataFrame, seed: str, size: int, quota: int, exclude: DataFrame | None = None) -> DataFrame:
    """assigned() rows with `size` of the retrieval_only ones made frozen2.

    Rows of documents with a development row, or with a row in `exclude` (id), are left as they are;
    too few eligible rows are an error.
    """
    tuned = rows.where("role = 'development'").select("document")
    free = rows.where("role = 'retrieval_only'")
    if exclude is not None:
        tuned = tuned.union(rows.join(exclude.select("id").distinct(), "id", "left_semi").select("document"))
    free = free.join(tuned.distinct(), "document", "left_anti")
    chosen = sample(free, seed, [("frozen2", size)], quota)
    if len(chosen) < size:
        raise ValueError(f"sample too small: {len(chosen)} of {size}")
    return _roles(rows.withColumnRenamed("role", "old"), chosen).withColumn("role", F.coalesce("role", "old")).drop("old")
