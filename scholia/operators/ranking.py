"""Top-k, fusion, paging and evidence selection over rows (query, doc, score or rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, query: str, doc: str, score: str, k: int | None = None) -> DataFrame:
    """Rank by score descending, then id; k keeps the first k of each query.

    Spark turns the filter on row_number into a limit per group before the shuffle.
    """
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), doc)))
    return out if k is None else out.where(F.col("rank") <= k)


def first_occurrence(ranking: DataFrame, query: str, doc: str, rank: str = "rank") -> DataFrame:
    """Each id at its best rank only, ranks made dense again."""
    best = ranking.groupBy(query, doc).agg(F.min(rank).alias("_r"))
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(query).orderBy("_r", doc))).drop("_r")


def fuse(rankings: DataFrame, query: str, doc: str, branch: str, rank: str = "rank", k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + best rank in each list), ties by id."""
    if k < 1:
        raise ValueError("k must be positive")
    best = rankings.groupBy(query, doc, branch).agg(F.min(rank).alias("_r"))
    return ranked(best.groupBy(query, doc).agg(F.sum(1.0 / (k + F.col("_r"))).alias("score")), query, doc, "score", limit)


def best_per_group(hits: DataFrame, query: str, group: str, doc: str, score: str, limit: int) -> DataFrame:
    """The best hit of each group, then the best `limit` groups of each query."""
    top = hits.withColumn("_g", F.row_number().over(Window.partitionBy(query, group).orderBy(F.desc(score), doc))).where("_g = 1").drop("_g")
    return ranked(top, query, group, score, limit)


def capped(ranking: DataFrame, query: str, group: str, rank: str, per_group: int, overall: int) -> DataFrame:
    """At most per_group of each group, then at most overall, in rank order."""
    own = ranking.withColumn("_n", F.row_number().over(Window.partitionBy(query, group).orderBy(rank))).where(F.col("_n") <= per_group)
    return own.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(rank))).where(F.col("position") <= overall).drop("_n")


def fill_budget(rows: DataFrame, query: str, order: Column, item: Column, tokens: Column, budget: int) -> DataFrame:
    """Greedy fill in order: what does not fit is skipped and later items may still fit."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("item"), tokens.cast("long").alias("tokens"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<item:long,used:long>>").alias("taken"))

    def step(s, x):
        fits = s["used"] + x["tokens"] <= budget
        taken = F.struct(x["item"].cast("long").alias("item"), (s["used"] + x["tokens"]).alias("used"))
        return F.when(fits, F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["taken"], F.array(taken)).alias("taken"))).otherwise(s)

    folded = rows.groupBy(query).agg(F.aggregate(items, start, step, lambda s: s["taken"]).alias("taken"))
    return folded.select(query, F.posexplode("taken").alias("pos", "t")).select(query, (F.col("pos") + 1).alias("position"), F.col("t.item").alias("item"), F.col("t.used").alias("used"))


def page(ranking: DataFrame, rank: str, offset: int, limit: int) -> DataFrame:
    return ranking.where((F.col(rank) > offset) & (F.col(rank) <= offset + limit))
