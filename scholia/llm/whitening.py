"""Whitening of embeddings by a tiled covariance.

Entries become whole numbers (256 times the entry, rounded down); the distinct vectors of them are
the fit list.  Its rows are packed into row-blocks; each block's columns are cut into pieces of TILE
dimensions, centred, and shuffled by row-block.  Pieces of one row-block meet in pairs, each pair
gives the product that one tile of the covariance needs, products are summed for each tile, and the
tiles are assembled and decomposed on the driver (dimensions squared, whatever the number of rows).

Sums and deviations are exact whole numbers.  Rows are read again for the projection; the identity
error is measured on the whole fit list.

Defined results: rows whose vector is null, or has null or non-finite entries, have no result; nor
have rows whose vector is not of the most common length (of those, of the longest), as they have no
covariance with the others.  Null and repeated vec_ids and repeated vectors keep their rows.  Entries
beyond the range of a long count as its limits.  A component without variance (rank below its number)
has whitened 0, and is not part of the identity error; with no variance at all, explained is 0.  A
deviation beyond a long is null.  An empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut

#: Dimensions in a tile, entries in a row-block, components in a result.
TILE, BLOCK_ENTRIES, COMPONENTS = 16, 1 << 18, 4
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): x is the vector of whole numbers as little-endian longs in one binary value."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1)
            lists, values = [], column.flatten().cast(pa.float64())
            flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bounds = np.r_[0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(256.0 * flat)
            x = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.where(scaled <= -(2.0**63), np.iinfo(np.int64).min, 0))
            inside = np.abs(scaled) < 2.0**63
            x[inside] = scaled[inside].astype(np.int64)
            raw = memoryview(np.ascontiguousarray(x, "<i8").view(np.uint8))
            ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[bounds[1:]] == bad[bounds[:-1]])
            for k in np.flatnonzero(ok):
                lists.append(bytes(raw[8 * bounds[k] : 8 * bounds[k + 1]]))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.array(lists, pa.binary())], names=["vec_id", "x"])

    return embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, x binary")


def _vectors(part: pa.RecordBatch, dims: int, column: int) -> np.ndarray:
    """The binary column as rows of whole numbers."""
    return np.frombuffer(b"".join(part.column(column).to_pylist()), "<i8").reshape(part.num_rows, dims)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sums of its dimensions: a row from each task, added as decimals."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for part in parts:
            x = _vectors(part, dims, 0)
            n += len(x)
            high += (x >> 32).sum(axis=0)  # halves, so that no sum of a task overflows
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * dims), "dim": pa.array(range(dims)), "high": pa.array(high), "low": pa.array(low)})

    summed = fit.select("x").mapInArrow(run, "n long, dim long, high long, low long").groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    rows = sorted(summed.collect())
    return (int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]) if rows else (0, [0] * dims)


def _centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the exact mean, which is a whole part and a rest below one."""
    return (x - mean).astype(np.float64) - rest


def column_blocks(fit: DataFrame, dims: int, mean: np.ndarray, rest: np.ndarray, tile: int = TILE, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(block, tile, piece): the centred columns of one tile of each row-block, as doubles by rows."""
    most = max(1, entries // max(dims, 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number, held = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            c = np.concatenate(held)
            pieces = [np.ascontiguousarray(c[:, t : t + tile]).tobytes() for t in range(0, dims, tile)]
            return pa.RecordBatch.from_pydict({"block": pa.array([first + number] * len(pieces), pa.int64()), "tile": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())})

        for part in parts:
            c = _centred(_vectors(part, dims, 0), mean, rest)
            for start in range(0, len(c), most):
                held.append(c[start : start + most])
                if sum(map(len, held)) >= most:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    return fit.select("x").mapInArrow(run, "block long, tile int, piece binary")


def tiles(pieces: DataFrame, dims: int, tile: int = TILE) -> DataFrame:
    """(i, j, entries): the sums of products of each pair of tiles i <= j over all row-blocks."""
    width = lambda t: min(tile, dims - t * tile)

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            for i, j, a, b in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                product = np.frombuffer(a).reshape(-1, width(i)).T @ np.frombuffer(b).reshape(-1, width(j))
                total[i, j] = total[i, j] + product if (i, j) in total else product
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array([k[0] for k in total], pa.int32()), "j": pa.array([k[1] for k in total], pa.int32()), "entries": pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))})

    left, right = pieces.alias("a"), pieces.alias("b")
    pairs = left.join(right.hint("merge"), (F.col("a.block") == F.col("b.block")) & (F.col("a.tile") <= F.col("b.tile")))
    products = pairs.select(F.col("a.tile").alias("i"), F.col("b.tile").alias("j"), F.col("a.piece").alias("a"), F.col("b.piece").alias("b")).mapInArrow(multiply, "i int, j int, entries array<double>")
    each = products.select("i", "j", F.posexplode("entries").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    return each.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("entries"))


def assemble(found: DataFrame, dims: int, n: int, tile: int = TILE) -> np.ndarray:
    """The covariance from its tiles."""
    out = np.zeros((dims, dims))
    for r in found.toLocalIterator():
        a, b = r["i"] * tile, r["j"] * tile
        m = np.array(r["entries"]).reshape(min(tile, dims - a), min(tile, dims - b)) / n
        out[a : a + m.shape[0], b : b + m.shape[1]] = m
        out[b : b + m.shape[1], a : a + m.shape[0]] = m.T
    return out


def principal(cov: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k eigenvalues by falling value, their vectors as columns, and their shares of the trace."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    trace = float(np.trace(cov))
    return values[order], vectors[:, order], values[order] / trace if trace > 0 else np.zeros(len(order))


def _scales(values: np.ndarray, dims: int) -> np.ndarray:
    """1 / sqrt of the eigenvalues; 0 for those that are rounding errors of 0."""
    floor = max(values[0], 0.0) * dims * np.finfo(float).eps if len(values) else 0.0
    ok = values > floor
    return np.where(ok, 1 / np.sqrt(np.where(ok, values, 1.0)), 0.0)


def _identity_error(fit: DataFrame, dims: int, n: int, mean: np.ndarray, rest: np.ndarray, weights: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance less the identity, over components with variance."""
    k = weights.shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for part in parts:
            w = _centred(_vectors(part, dims, 0), mean, rest) @ weights
            products += w.T @ w
            sums += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k * k + k)), "v": pa.array(np.r_[products.ravel(), sums])})

    got = {r["at"]: r["v"] for r in fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([got.get(i, 0.0) for i in range(k * k + k)]) / n
    cov = flat[: k * k].reshape(k, k) - np.outer(flat[k * k :], flat[k * k :])
    live = np.abs(weights).max(axis=0, initial=0.0) > 0
    return float(np.abs((cov - np.eye(k))[np.ix_(live, live)]).max(initial=0.0))


def whitened(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """Rows of _OUT: each remaining row's first components, with its deviation and the fit's quality."""
    rows = cut(whole(embeddings, vec_id, vector), "whole")
    common = rows.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None or common["size"] == 0:
        return embeddings.sparkSession.createDataFrame([], _OUT)
    dims = common["size"] // 8
    rows = rows.where(F.octet_length("x") == common["size"])
    fit = cut(rows.select("x").distinct(), "fit")
    n, totals = _sums(fit, dims)
    mean, rest = np.array([s // n for s in totals], np.int64), np.array([(s % n) / n for s in totals])
    values, vectors, share = principal(assemble(tiles(cut(column_blocks(fit, dims, mean, rest, tile), "pieces"), dims, tile), dims, n, tile), components)
    weights = vectors * _scales(values, dims)
    error = _identity_error(fit, dims, n, mean, rest, weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weights.shape[1]
        for part in parts:
            x = _vectors(part, dims, 1)
            w = _centred(x, mean, rest) @ weights
            deviation = pa.array([v for v in _deviations(x, n, totals) for _ in range(k)], pa.int64())
            m = len(x)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation, pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _OUT)


def _deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)^2: in longs where they surely fit, else in Python's whole numbers."""
    rough = ((x.astype(np.float64) * n - np.array(totals, np.float64)) ** 2).sum(axis=1)
    small = (rough < 2.0**62) & (np.abs(x).max(axis=1, initial=0) < 2.0**62 / n) & (max(map(abs, totals), default=0) < 2**62)
    out: list[int | None] = [0] * len(x)
    d = x[small] * n - np.array(totals if small.any() else [0] * x.shape[1], np.int64)
    for k, v in zip(np.flatnonzero(small), (d * d).sum(axis=1).tolist(), strict=True):
        out[k] = v
    for k in np.flatnonzero(~small):
        v = sum((n * a - s) ** 2 for a, s in zip(x[k].tolist(), totals, strict=True))
        out[k] = v if v < 2**63 else None
    return out
