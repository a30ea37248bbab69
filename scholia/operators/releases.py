"""Releases of a corpus index: staged, built, validated, activated and dropped.

A release is a JSON record beside the tables it names; the active one is named by a pointer that is
replaced in one step.  A job reads the pointer once and keeps what it captured, whatever is activated
meanwhile; a release that is replaced keeps its tables until it is dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import exists, read_json, remove, write_json
from . import dense, evidence, lexical, ordinals, ranking
from .digests import ranged_digest

KINDS = ("papers", "chunks")
# Fixed values of canary rankings: how many, how long, words of a query, results read beyond, and the tie.
CANARIES, CANARY_LIMIT, CANARY_TERMS, CANARY_SLACK, TIE = 5, 10, 12, 20, 1e-6


class ReleaseError(ValueError):
    """code: release_unknown, release_conflict, release_not_staged, release_active, collections_must_differ or index_validation_failed."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


class Releases:
    """The releases of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, release: str) -> str:
        return f"{self.folder}/releases/{release}.json"

    def _active(self) -> str | None:
        pointer = read_json(self.spark, f"{self.folder}/active.json")
        return pointer and pointer["release"]

    def _stored(self, release: str) -> dict[str, Any]:
        record = read_json(self.spark, self._file(release))
        if record is None:
            raise ReleaseError("release_unknown", release)
        return record

    def load(self, release: str) -> dict[str, Any]:
        record = self._stored(release)
        served = record.pop("served")
        return record | {"status": "active" if self._active() == release else "superseded" if served else "staged"}

    def capture(self) -> dict[str, Any] | None:
        """The active release, by one look at the pointer; the caller uses it to the end of its job."""
        active = self._active()
        return None if active is None else self.load(active) | {"status": "active"}

    def stage(self, release: str, papers: str, chunks: str, model: str, manifest: str, manifest_sha256: str) -> str:
        """Record a release; staging it again with the same contents changes nothing."""
        if papers == chunks:
            raise ReleaseError("collections_must_differ", papers)
        own = {"papers": papers, "chunks": chunks, "model": model, "manifest_sha256": manifest_sha256}
        old = read_json(self.spark, self._file(release))
        if old is not None and any(old[k] != v for k, v in own.items()):
            raise ReleaseError("release_conflict", release)
        if old is None:
            write_json(self.spark, self._file(release), own | {"id": release, "manifest": manifest, "builds": {}, "served": False})
        return release

    def record_build(self, release: str, kind: str, details: dict[str, Any]) -> None:
        """Attach what was built to a staged release; one that has served keeps what it claims."""
        if not exists(self.spark, self._file(release)) or self.load(release)["status"] != "staged":
            raise ReleaseError("release_not_staged", release)
        record = self._stored(release)
        write_json(self.spark, self._file(release), record | {"builds": record["builds"] | {kind: details}})

    def activate(self, release: str, problems: Callable[[dict[str, Any]], list[str]]) -> str:
        """Point readers at the release if nothing is wrong with it; else the active one stays."""
        found = problems(self.load(release))
        if found:
            raise ReleaseError("index_validation_failed", "; ".join(found))
        write_json(self.spark, self._file(release), self._stored(release) | {"served": True})
        write_json(self.spark, f"{self.folder}/active.json", {"release": release})
        return release

    def drop(self, release: str) -> dict[str, Any]:
        """Forget a release that is not active, with its tables."""
        if self._active() == release:
            raise ReleaseError("release_active", release)
        record = self.load(release)
        remove(self.spark, self._file(release))
        for kind in KINDS:
            remove(self.spark, record[kind])
        return record


def write_manifest(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """The snapshot's manifest over tables (id, text), of count and digest for each; returns its own digest."""
    value = {"schema_version": 2, "tables": {k: dict(zip(("rows", "digest"), ranged_digest(t, "id", "text").first(), strict=True)) for k, t in tables.items()}}
    write_json(spark, path, value)
    return file_sha256(spark, path)


def file_sha256(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def build(docs: DataFrame, folder: str, model: str, limit: int | None = None) -> dict[str, Any]:
    """Index tables of docs (id, text) below the folder: points, postings by term bucket, vocabulary; returns the build record.

    The record holds counts, digests and the canaries: some documents by position, each with the
    exact results for its first words.  A limit builds from the first documents in id order, for
    measurements; such a build is never activated.
    """
    spark = docs.sparkSession
    if limit is not None:
        docs = docs.orderBy("id").limit(limit)
    points = evidence.fixture_embedding(docs, "id", "text").select("id", F.array("x", "y").alias("vector"))
    points.write.mode("overwrite").parquet(f"{folder}/points")
    documents, mean = lexical.write_index(docs, "id", "text", folder)
    rows, digest = ranged_digest(docs, "id", "text").first()
    own = {"points": spark.read.parquet(f"{folder}/points").count(), "rows": rows, "digest": digest, "dimensions": 2, "model": model, "limit": limit}
    own |= {"documents": documents, "average_length": mean, "vocabulary_sha256": vocabulary_digest(spark, folder)}
    heads = [(r["id"], " ".join(r["text"].split()[:CANARY_TERMS])) for r in ordinals.every_nth(docs, "id", CANARIES).select("id", F.coalesce("text", F.lit("")).alias("text")).orderBy("id").collect()]
    asked = canary_queries(spark, heads, folder, documents)
    found = search_canaries(spark, folder, asked, CANARY_LIMIT)
    return own | {"canaries": [a | found[k] for k, a in enumerate(asked)]}


def vocabulary_digest(spark: SparkSession, folder: str) -> str:
    """A digest of (term, df) that needs no order: the exact sum of row hashes, and the number of rows."""
    rows = spark.read.parquet(f"{folder}/vocabulary").select(F.xxhash64("term", "df").cast("decimal(38,0)").alias("h"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{n}:{total}"


def canary_queries(spark: SparkSession, heads: list[tuple[int, str]], folder: str, documents: int) -> list[dict[str, Any]]:
    """The dense and sparse query of each canary text."""
    if not heads:
        return []
    rows = spark.createDataFrame(heads, "id long, text string")
    vectors = {r["id"]: [r["x"], r["y"]] for r in evidence.fixture_embedding(rows, "id", "text").collect()}
    terms = rows.select("id", F.explode(F.array_distinct(lexical.terms(F.col("text")))).alias("term")).join(spark.read.parquet(f"{folder}/vocabulary"), "term")
    sparse: dict[int, dict[str, float]] = {}
    for r in terms.select("id", "term", lexical.idf(F.lit(documents), F.col("df")).alias("idf")).collect():
        sparse.setdefault(r["id"], {})[r["term"]] = r["idf"]
    return [{"id": i, "dense_query": vectors[i], "sparse_query": sparse.get(i, {})} for i, _ in heads]


def search_canaries(spark: SparkSession, folder: str, asked: list[dict[str, Any]], limit: int) -> list[dict[str, Any]]:
    """The exact results of each canary: (id, score) lists by falling score, then id."""
    out: list[dict[str, Any]] = [{"dense": [], "sparse": []} for _ in asked]
    if not asked:
        return out
    queries = spark.createDataFrame([(k, a["dense_query"]) for k, a in enumerate(asked)], "q long, vector array<double>")
    near = dense.search(spark.read.parquet(f"{folder}/points"), queries, "id", "vector", "q", limit)
    weights = [(k, t, w) for k, a in enumerate(asked) for t, w in sorted(a["sparse_query"].items())]
    words = spark.createDataFrame(weights, "q long, term string, w double").withColumn("bucket", lexical.bucket_of(F.col("term")))
    buckets = [r[0] for r in words.select("bucket").distinct().collect()]
    stored = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets))
    scores = stored.join(F.broadcast(words.drop("bucket")), "term").groupBy("q", "id").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))  # a few words for each canary
    for name, rows in (("dense", near), ("sparse", ranking.ranked(scores, "q", "id", "score", limit))):
        for r in rows.orderBy("q", "rank").collect():
            out[r["q"]][name].append([r["id"], r["score"]])
    return out


def same_ranking(expected: list, actual: list, tie: float = TIE) -> bool:
    """Scores agree place by place and each expected item is there with its own score; only ties may trade places."""
    close = lambda a, b: abs(a - b) <= max(tie, tie * max(abs(a), abs(b)))
    served = dict(map(tuple, actual))
    return len(actual) >= len(expected) and all(close(e[1], a[1]) for e, a in zip(expected, actual, strict=False)) and all(i in served and close(served[i], s) for i, s in expected)


def release_problems(spark: SparkSession, release: dict[str, Any], model: str, dimensions: int = 2) -> list[str]:
    """Everything that stops the release from serving."""
    problems = [] if release["model"] == model else [f"model {release['model']} is not {model}"]
    snapshot = read_json(spark, release["manifest"])
    if not snapshot or snapshot.get("schema_version") != 2:
        return [*problems, "snapshot unusable"]
    if file_sha256(spark, release["manifest"]) != release["manifest_sha256"]:
        problems.append("snapshot manifest changed since staging")
    for kind in KINDS:
        built, folder = release["builds"].get(kind), release[kind]
        if built is None:
            problems.append(f"{kind}: not built")
            continue
        if built["limit"] is not None:
            problems.append(f"{kind}: measurement build of the first {built['limit']} documents")
        if not exists(spark, f"{folder}/points"):
            problems.append(f"{kind}: missing")
            continue
        points = spark.read.parquet(f"{folder}/points")
        stored, wide = points.agg(F.count("*"), F.count_if(F.size("vector") != dimensions)).first()
        if wide:
            problems.append(f"{kind}: {wide} vectors without {dimensions} dimensions")
        wanted = snapshot["tables"][kind]
        if not stored == built["points"] == wanted["rows"]:
            problems.append(f"{kind}: {stored} points, built {built['points']}, snapshot {wanted['rows']}")
        if built["digest"] != wanted["digest"]:
            problems.append(f"{kind}: indexed content does not match the snapshot digest")
        if not exists(spark, f"{folder}/vocabulary") or vocabulary_digest(spark, folder) != built["vocabulary_sha256"]:
            problems.append(f"{kind}: term statistics missing or altered")
        found = search_canaries(spark, folder, built["canaries"], CANARY_LIMIT + CANARY_SLACK)
        for k, (old, new) in enumerate(zip(built["canaries"], found, strict=True)):
            problems += [f"{kind}: {name} canary {k} ranking changed" for name in ("dense", "sparse") if not same_ranking(old[name], new[name])]
    return problems
