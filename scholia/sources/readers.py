"""Sources and sinks as DataFrames: registries, JSON lines, listings, snapshots with checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import remove


def _own_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/scholia-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path in this application's folder below the one that the cluster shares; one of our own only where none is set."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Batches that go to Python hold few rows and bytes, so that a worker's memory does not follow the rows of its task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def clean(spark: SparkSession) -> bool:
    """Delete all that this application wrote to scratch(); for the end of a job, when no result is read any more."""
    return remove(spark, _own_folder(spark))


def read_registry(spark: SparkSession, path: str, columns: list[str], equal: dict, order: str) -> DataFrame:
    """Projected Parquet scan with pushed equality filters, in id order."""
    df = spark.read.parquet(path).select(*columns)
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return df.orderBy(order)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank lines and # comments; a malformed line is an error."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim(F.col("value")).startswith("#"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def round_trip(df: DataFrame, kind: str, **options) -> DataFrame:
    """Write df to a scratch folder in a format and read it back with its schema."""
    path = scratch(df.sparkSession)
    df.write.options(**options).format(kind).save(path)
    return df.sparkSession.read.options(**options).format(kind).schema(df.schema).load(path)


def write_snapshot(df: DataFrame, path: str, key: str, text: str, max_records: int = 1_000_000) -> DataFrame:
    """Rolling Parquet shards with each row's text digest; returns the one-row manifest."""
    stamped = df.withColumn("text_sha256", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    stamped.write.option("maxRecordsPerFile", max_records).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))


def read_snapshot(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Rows whose text no longer matches its digest raise an error as they are read."""
    df = spark.read.parquet(path)
    ok = F.assert_true(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256) == F.col("text_sha256"), F.lit("text does not match its digest"))
    return df.where(F.coalesce(ok.cast("string"), F.lit("")) == "")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def missing(wanted: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """The resumable plan: what is wanted and not there yet."""
    return wanted.join(present.select(on).distinct(), on, "left_anti")


def cached(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Requests with a hit flag and the cached columns (null on a miss)."""
    return requests.join(cache.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def url_parts(url: Column) -> Column:
    return F.struct(F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), F.parse_url(url, F.lit("QUERY")).alias("query"))
