"""Stratified samples against a plain walk over all rows, and bootstraps against one matrix of draws."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholia.functions import stats
from scholia.operators import sampling


def plain(rows, seed, roles, quota):
    """The walk over all rows of each stratum, without any limit."""
    digest = lambda i, s: hashlib.sha256(":".join(str(x) for x in (seed, s, i) if x is not None).encode()).hexdigest()
    strata = defaultdict(list)
    for i, s, d in rows:
        strata[s].append((digest(i, s), i, d))
    for queue in strata.values():
        queue.sort()
    order = sorted(strata)
    taken, out, at = Counter(), {}, dict.fromkeys(order, 0)
    for role, wanted in roles:
        filled, done = 0, set()
        while filled < wanted and len(done) < len(order):
            for s in order:
                if filled >= wanted or s in done:
                    continue
                while at[s] < len(strata[s]):
                    _, i, d = strata[s][at[s]]
                    at[s] += 1
                    if taken[d] < quota:
                        taken[d] += 1
                        out[i] = role
                        filled += 1
                        break
                else:
                    done.add(s)
    return out


def rows(seed, n, documents, strata):
    r = random.Random(seed)
    return [(f"q{i}", f"s{min(int(r.expovariate(0.7)), strata - 1)}", f"d{min(int(r.expovariate(3 / documents)), documents - 1)}") for i in range(n)]


@pytest.mark.parametrize(("n", "documents", "strata", "frozen", "development", "quota"), [(600, 40, 4, 50, 30, 2), (600, 5, 3, 40, 20, 3), (50, 60, 5, 100, 100, 1), (300, 1, 2, 4, 4, 6)])
def test_sample_equals_a_plain_walk(spark, n, documents, strata, frozen, development, quota):
    data = rows(n, n, documents, strata)
    table = spark.createDataFrame(data, "id string, stratum string, document string").repartition(5)
    want = plain(data, 7, [("frozen", frozen), ("development", development)], quota)
    got = {r["id"]: r["role"] for r in sampling.assigned(table, 7, frozen, development, quota).collect()}
    assert got == {i: want.get(i, "retrieval_only") for i, *_ in data}


def test_second_sample(spark):
    data = rows(3, 500, 60, 4)
    table = spark.createDataFrame(data, "id string, stratum string, document string")
    first = plain(data, 7, [("frozen", 30), ("development", 20)], 2)
    exclude = {"q1", "q2"}
    tuned = {d for i, _, d in data if first.get(i) == "development" or i in exclude}
    want = plain([x for x in data if x[0] not in first and x[2] not in tuned], "again", [("frozen2", 25)], 2)
    assigned = sampling.assigned(table, 7, 30, 20, 2)
    got = sampling.second_sample(assigned, "again", 25, 2, spark.createDataFrame([(i,) for i in exclude], "id string"))
    assert {r["id"]: r["role"] for r in got.collect() if r["role"] != "retrieval_only"} == first | want
    with pytest.raises(ValueError, match="too small"):
        sampling.second_sample(assigned, "again", 400, 2)


def test_bootstrap_of_families_equals_one_matrix(spark):
    r = np.random.default_rng(5)
    data = [(f"f{k:03d}", float(v)) for k in range(150) for v in r.normal(size=1 + k % 3)]
    m = np.array([np.mean([v for f, v in data if f == g]) for g in sorted({f for f, _ in data})])
    found = m[stats.bootstrap_draws(3, len(m), 400)].mean(axis=1)
    got = stats.family_bootstrap(spark.createDataFrame(data, "f string, v double").repartition(6), "f", "v", 3, 400).first()
    assert (got["mean"], got["low"], got["high"], got["families"]) == pytest.approx((m.mean(), *np.percentile(found, [2.5, 97.5]), 150))
    assert tuple(stats.family_bootstrap(spark.createDataFrame([], "f string, v double"), "f", "v").first()) == (None, None, None, 0)


def test_bootstrap_in_pieces_of_the_stream(spark):
    units = spark.range(97).selectExpr("id", "cast(id * id as double) as v")
    got, n = stats.resampled(units, ["id"], ["v"], 11, 50, piece=10)
    want = (np.arange(97) ** 2)[stats.bootstrap_draws(11, 97, 50)].sum(axis=1)
    assert n == 97 and [r["v"] for r in got.orderBy("replicate").collect()] == pytest.approx(list(map(float, want)))


def test_bootstrap_of_rates_equals_one_matrix(spark):
    r = random.Random(9)
    data = [(g, r.randrange(5), r.randrange(5, 9), r.randrange(4), r.randrange(4, 7)) for g in range(80)]
    a = np.array(data, float)
    pick = stats.bootstrap_draws(0, 80, 300)
    want = np.percentile(a[pick, 1].sum(axis=1) / a[pick, 2].sum(axis=1) - a[pick, 3].sum(axis=1) / a[pick, 4].sum(axis=1), [2.5, 97.5])
    got = stats.rate_bootstrap(spark.createDataFrame(data, "g long, a long, n long, b long, m long"), ["g"], ("a", "n"), ("b", "m"), 0, 300).first()
    assert (got["low"], got["high"], got["groups"]) == pytest.approx((*want, 80))
