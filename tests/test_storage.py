"""Row numbers, order statistics, versioned tables and releases against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import chunking, ordinals, releases
from scholia.sources import stored, versions
from scholia.sources.readers import scratch


@pytest.fixture
def many_parts(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 997, numPartitions=5).select(((F.col("id") * 37) % 997).alias("k"), F.lit("same").alias("s"))
    assert sorted((r["k"], r["position"]) for r in ordinals.numbered(rows, "k").collect()) == [(k, k) for k in range(997)]
    assert sorted(r["position"] for r in ordinals.numbered(rows, "s", "k").collect()) == list(range(997))
    assert ordinals.numbered(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize(("rows", "n"), [(23, 5), (4, 5), (1, 5), (100, 7)])
def test_every_nth(spark, rows, n):
    step = max(1, rows // n)
    got = sorted(r["k"] for r in ordinals.every_nth(spark.range(rows).withColumn("k", F.col("id") * 3).drop("id"), "k", n).collect())
    assert got == [3 * p for p in list(range(0, rows, step))[:n]]


def test_order_statistics_of_groups_of_every_size(spark):
    r = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in r.normal(size=3000)] + [("ties", float(v)) for v in r.integers(0, 3, 500)] + [("one", 4.0), ("null", None), (None, 1.0), (None, 2.0), ("two", -1.0), ("two", 5.0), ("two", None)]
    wanted = {"median": (0.5, "linear"), "p95": (0.95, "linear"), "p95_index": (0.95, "index"), "worst": (1.0, "index"), "least": (0.0, "index")}
    got = {x["g"]: x for x in ordinals.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", wanted).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    assert set(got) == set(by)
    for g, values in by.items():
        values.sort()
        for name, (share, rule) in wanted.items():
            want = np.percentile(values, 100 * share) if rule == "linear" else values[min(math.floor(share * len(values)), len(values) - 1)]
            assert got[g][name] == pytest.approx(want)


def test_order_statistics_spread_a_hot_group(spark, many_parts):
    """No task of the placing window holds more than its range of one group's values."""
    placed = ordinals.ranges(spark.range(20_000).select(F.lit(1).alias("g"), "id"), ["g"], "id")
    assert placed.where("low <> id or high <> id + 1 or total <> 20000").count() == 0
    assert placed.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def chunks(spark, rows):
    return chunking.fixed_windows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4, 1)


def test_replacing_versions(spark):
    path, order = scratch(spark), ["doc_id", "ordinal"]
    first = [(i, " ".join(f"w{i}" for _ in range(3 * (i % 5)))) for i in range(200)]
    versions.write_versions(chunks(spark, first), path, "doc_id", order)
    fresh = [(i, f"new {i}") for i in range(0, 200, 3)]
    changed = spark.range(0, 200, 3).union(spark.range(1, 200, 3)).withColumnRenamed("id", "doc_id")
    want = sorted(map(tuple, chunks(spark, fresh + [r for r in first if r[0] % 3 == 2]).collect()))
    rows = lambda: sorted(map(tuple, versions.read_versions(spark, path).select("doc_id", "ordinal", "token_count", "chunk").collect()))
    for _ in range(2):
        versions.replace_versions(spark, path, chunks(spark, fresh), changed, "doc_id", order)
        assert rows() == want
    with pytest.raises(ValueError, match="not replaced"):
        versions.replace_versions(spark, path, chunks(spark, [(5, "x")]), changed.where("doc_id = 6"), "doc_id", order)
    assert rows() == want
    every = spark.range(200).withColumnRenamed("id", "doc_id")
    written = versions.replace_versions(spark, path, chunks(spark, []), every, "doc_id", order)
    assert sum(r["rows"] for r in written.collect()) == 0 and not stored.exists(spark, f"{path}/bucket=0")


def test_one_version_of_most_rows_is_written_by_several_tasks(spark, many_parts):
    path = scratch(spark)
    rows = spark.range(5000).select(F.lit(1).alias("v"), F.col("id").alias("ordinal"))
    versions.write_versions(rows, path, "v", ["v", "ordinal"])
    assert versions.read_versions(spark, path).select(F.input_file_name().alias("f")).distinct().count() > 1


def test_records_are_replaced_as_a_whole(spark):
    path = scratch(spark) + "/a.json"
    assert stored.read_json(spark, path) is None
    for value in ({"a": 1}, {"b": [1, "é"]}):
        stored.write_json(spark, path, value)
        assert stored.read_json(spark, path) == value
    assert stored.remove(spark, path) and not stored.remove(spark, path)


def test_release_states_and_refusals(spark):
    store = releases.Releases(spark, scratch(spark))
    ok, bad = (lambda r: []), (lambda r: ["broken"])
    code = lambda f, *a: pytest.raises(releases.ReleaseError, f, *a).value.code
    stage = lambda name, model="m": store.stage(name, f"/p/{name}", f"/c/{name}", model, "/manifest", "sha")
    assert store.capture() is None and code(store.load, "a") == "release_unknown"
    assert code(store.stage, "a", "/same", "/same", "m", "/manifest", "sha") == "collections_must_differ"
    assert stage("a") == stage("a") == "a" and code(stage, "a", "other") == "release_conflict"
    store.record_build("a", "papers", {"points": 1})
    assert store.load("a")["status"] == "staged" and store.load("a")["builds"] == {"papers": {"points": 1}}
    assert code(store.activate, "a", bad) == "index_validation_failed" and store.capture() is None and store.load("a")["status"] == "staged"
    store.activate("a", ok)
    before = store.capture()
    assert before["id"] == "a" and code(store.record_build, "a", "chunks", {}) == "release_not_staged" and code(store.drop, "a") == "release_active"
    stage("b")
    assert code(store.activate, "b", bad) == "index_validation_failed" and store.capture()["id"] == "a"
    store.activate("b", ok)
    assert before["papers"] == "/p/a" and store.load("a")["status"] == "superseded" and store.capture()["id"] == "b"
    store.activate("a", ok)  # back again
    assert store.capture()["id"] == "a" and store.drop("b")["status"] == "superseded" and code(store.drop, "b") == "release_unknown"
    assert code(store.record_build, "b", "papers", {}) == "release_not_staged"


def test_same_ranking():
    expected = [[1, 0.9], [2, 0.5], [3, 0.5]]
    assert releases.same_ranking(expected, [[1, 0.9], [3, 0.5], [2, 0.5], [4, 0.1]])
    assert releases.same_ranking(expected, [[1, 0.9], [4, 0.5], [2, 0.5], [3, 0.5]])
    assert not releases.same_ranking(expected, [[1, 0.9], [4, 0.5], [2, 0.5]])  # one is missing
    assert not releases.same_ranking(expected, [[1, 0.9], [2, 0.5]]) and not releases.same_ranking(expected, [[1, 0.8], [2, 0.5], [3, 0.5]])
    assert releases.same_ranking([], [])
