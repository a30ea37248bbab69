"""Exact cosine search of a query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked

#: Bytes of query vectors in one broadcast block.
QUERY_BYTES = 32 << 20


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _matrix(column) -> np.ndarray:
    m = np.stack([np.asarray(x, np.float64) for x in column.to_pylist()]) if len(column) else np.zeros((0, 1))
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def search(vectors: DataFrame, queries: DataFrame, doc: str, vector: str, query: str, k: int, keep_self: bool = True, digits: int | None = None) -> DataFrame:
    """Top k by cosine of every query: each partition keeps its own k for each query, then one merge.

    Queries are read in blocks of bounded size, each broadcast; every vector is compared with each.
    With `digits`, scores that agree in so many decimals are ties; ties are broken by id.
    """
    spark = vectors.sparkSession
    blocks, room = [[]], QUERY_BYTES
    for row in queries.select(query, F.col(vector).alias("_v")).where("_v is not null").toLocalIterator():
        size = 8 * len(row["_v"])
        if size > room and blocks[-1]:
            blocks.append([])
            room = QUERY_BYTES
        blocks[-1].append((row[0], row["_v"]))
        room -= size
    shared = [spark.sparkContext.broadcast((np.array([q for q, _ in b], np.int64), _matrix(pa.array([list(v) for _, v in b])))) for b in blocks if b]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        none = np.zeros(0, np.int64), np.zeros(0)
        for part in parts:
            ids, m = part.column(0).to_numpy(), _matrix(part.column(1))
            for n, block in enumerate(shared):
                q, v = block.value
                for start in range(0, len(q), 256):
                    scores = v[start : start + 256] @ m.T
                    if digits is not None:
                        scores = np.round(scores, digits)
                    if not keep_self:
                        scores[q[start : start + 256, None] == ids[None, :]] = -np.inf
                    for r, own in enumerate(scores):
                        old = best.get((n, start + r), none)
                        # only what reaches the k-th of the new scores can be among the first k
                        at = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
                        i, s = np.r_[old[0], ids[at]], np.r_[old[1], own[at]]
                        top = np.lexsort((i, -s))[:k]
                        best[n, start + r] = (i[top], s[top])
        for (n, r), (i, s) in best.items():
            ok = np.isfinite(s)
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(ok.sum(), shared[n].value[0][r])), "d": pa.array(i[ok]), "s": pa.array(s[ok])})

    found = vectors.select(F.col(doc).cast("long"), F.col(vector).alias("_v")).where("_v is not null").mapInArrow(run, f"{query} long, {doc} long, score double")
    return ranked(found, query, doc, "score", k)
