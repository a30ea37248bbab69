"""Evidence for answers: rerank, floor, caps, budget; and growth of a hit to its section."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import above_floor
from ..functions.text import token_arrays
from ..sources.readers import bounded_batches
from .ranking import capped, fill_budget


def overlap_score(query_terms: Column, document_terms: Column) -> Column:
    """Share of the query's distinct terms that the document has; 0 without terms."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, document_terms)) / F.size(q))


def rerank(head: DataFrame, query: str, score: Column, depth: int) -> DataFrame:
    """The first depth candidates by score, ties in incoming order; the incoming order stays where any score is not finite."""
    own = head.where(F.col("rank") <= depth).withColumn("_s", score.cast("double"))
    bad = F.max(F.coalesce(F.isnan("_s") | F.col("_s").isNull(), F.lit(True))).over(Window.partitionBy(query))
    w = Window.partitionBy(query).orderBy(F.when(F.col("_bad"), F.lit(0.0)).otherwise(-F.col("_s")), "rank")
    return own.withColumn("_bad", bad).withColumn("position", F.row_number().over(w)).withColumnRenamed("_s", "rerank_score").withColumnRenamed("_bad", "degraded")


def select_evidence(reranked: DataFrame, query: str, group: str, item: str, words: Column, floor: float | None, per_group: int, overall: int, budget: int) -> DataFrame:
    """Floor, caps and word budget in rank order; the result is numbered E1, E2, ..."""
    kept = reranked.where(above_floor(F.col("rerank_score"), floor))
    few = capped(kept.withColumn("_r", F.col("position")).drop("position"), query, group, "_r", per_group, overall)
    out = fill_budget(few, query, F.col("position"), F.col(item), words, budget)
    return out.withColumn("label", F.concat(F.lit("E"), F.col("position").cast("string")))


def expand(hits: DataFrame, sections: DataFrame, key: str, budget: int) -> DataFrame:
    """For each (key, ordinal) hit: the whole section if it fits the budget of characters, else the hit and following, then preceding chunks while they fit."""
    own = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk"))).alias("parts"))
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda s, p: s + F.length(p["chunk"]) + 2)
    joined = hits.join(own, key)
    after = F.filter("parts", lambda p: p["ordinal"] > F.col("ordinal"))
    before = F.reverse(F.filter("parts", lambda p: p["ordinal"] < F.col("ordinal")))
    start = F.filter("parts", lambda p: p["ordinal"] == F.col("ordinal"))

    def grow(taken, more):
        state = F.struct(taken.alias("taken"), F.lit(True).alias("open"))
        step = lambda s, p: F.when(s["open"] & (size(s["taken"]) + F.length(p["chunk"]) <= budget), F.struct(F.concat(s["taken"], F.array(p)).alias("taken"), F.lit(True).alias("open"))).otherwise(F.struct(s["taken"].alias("taken"), F.lit(False).alias("open")))
        return F.aggregate(more, state, step, lambda s: s["taken"])

    chosen = F.when(size(F.col("parts")) - 2 <= budget, F.col("parts")).otherwise(F.array_sort(grow(grow(start, after), before)))
    return joined.select(key, "ordinal", chosen.alias("c")).select(key, "ordinal", F.size("c").alias("chunks"), F.array_join(F.transform("c", lambda p: p["chunk"]), "\n\n").alias("text"))


#: Terms whose unit vectors a task keeps.
KEPT_TERMS = 1 << 17


def _unit(term: str) -> tuple[float, float]:
    angle = int.from_bytes(hashlib.sha256(term.encode()).digest()[:4], "big") / 4294967296.0 * 6.283185307179586
    return math.cos(angle), math.sin(angle)


def _term_sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the sums of cosines and sines of its terms' angles, in the order of the text."""
    known: dict[str, tuple[float, float]] = {}
    for part in parts:
        if len(known) > KEPT_TERMS:
            known.clear()
        flat, length = token_arrays(part.column(1).to_pylist())
        encoded = flat.dictionary_encode()
        units = np.array([known.get(t) or known.setdefault(t, _unit(t)) for t in encoded.dictionary.to_pylist()], float).reshape(-1, 2)
        code, row = encoded.indices.to_numpy(), np.repeat(np.arange(len(length)), length)
        sums = (np.bincount(row, units[code, k], len(length)).astype(float) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums)], [part.schema.names[0], "a", "b"])


def fixture_embedding(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x, y): the normalised sum of unit vectors, each term's angle from its digest; (1, 0) without terms."""
    bounded_batches(docs.sparkSession)
    own = docs.select(key, F.col(text).alias("_t")).mapInArrow(_term_sums, f"`{key}` {docs.schema[key].dataType.simpleString()}, a double, b double")
    total = own.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2)
    return total.select(key, F.when(n > 0, F.col("a") / n).otherwise(1.0).alias("x"), F.when(n > 0, F.col("b") / n).otherwise(0.0).alias("y"))
