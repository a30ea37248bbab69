"""Graded rank metrics: rows (query, doc, rank) against judgements (query, doc, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_occurrence


def judged(ranking: DataFrame, qrels: DataFrame, query: str, doc: str) -> DataFrame:
    """Deduplicated ranking with grades; null grade means unjudged."""
    return first_occurrence(ranking, query, doc).join(qrels.select(query, doc, "grade"), [query, doc], "left")


def ideal(qrels: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), doc))
    top = qrels.withColumn("_i", order).where(F.col("_i") <= k)
    return top.groupBy(query).agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("_i") + 1.0)).alias("ideal"))


def evaluate(ranking: DataFrame, qrels: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """ndcg, recall, mrr and judged share at k for every judged query; a query without results scores 0."""
    cut = F.col("rank") <= k
    rel = F.coalesce(F.col("grade") > 0, F.lit(False))
    own = judged(ranking, qrels, query, doc).groupBy(query).agg(
        F.sum(F.when(cut, (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count_if(cut & rel).alias("found"), F.min(F.when(cut & rel, F.col("rank"))).alias("first"),
        (F.count_if(cut & F.col("grade").isNotNull()) / F.count_if(cut)).alias("judged"),
    )
    asked = qrels.groupBy(query).agg(F.count_if(F.col("grade") > 0).alias("n_relevant"))
    out = asked.join(ideal(qrels, query, doc, k), query).join(own, query, "left")
    return out.select(
        query, F.coalesce(F.col("dcg") / F.nullif("ideal", F.lit(0.0)), F.lit(0.0)).alias("ndcg"), (F.coalesce("found", F.lit(0)) / F.nullif("n_relevant", F.lit(0))).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.col("judged"),
    )


def average_precision(ranking: DataFrame, qrels: DataFrame, query: str, doc: str) -> DataFrame:
    hits = judged(ranking, qrels, query, doc).where("grade > 0")
    hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("rank")))
    n = qrels.where("grade > 0").groupBy(query).agg(F.count("*").alias("n"))
    total = hits.groupBy(query).agg(F.sum(F.col("_n") / F.col("rank")).alias("s"))
    return n.join(total, query, "left").select(query, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ap"))


def passage_metrics(ranking: DataFrame, relevant: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """Binary recall and ndcg at k without removing repeats from the ranking."""
    hits = ranking.where(F.col("rank") <= k).join(relevant.select(query, doc).distinct().withColumn("_y", F.lit(1)), [query, doc], "left")
    n = relevant.select(query, doc).distinct().groupBy(query).agg(F.count("*").alias("n"))
    top = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    own = hits.groupBy(query).agg(F.sum(F.when(F.col("_y") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.countDistinct(F.when(F.col("_y") == 1, F.col(doc))).alias("found"))
    return n.join(own, query, "left").select(query, F.coalesce(F.col("dcg") / top, F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("recall"))
