"""Bounded BM25 search and blockwise cosine search against plain scoring of everything."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import dense, lexical
from scholia.sources.readers import scratch


def plain(docs, queries, k, digits=9, within=None):
    tf = {d: Counter(re.findall("[0-9a-z]+", (t or "").lower())) for d, t in docs}
    n, avg = len(docs), sum(sum(c.values()) for c in tf.values()) / max(len(docs), 1)
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for q, t in queries:
        terms = set(re.findall("[0-9a-z]+", (t or "").lower()))
        scores = []
        for d, c in tf.items():
            if within is not None and d not in within or not terms & set(c):
                continue
            length = sum(c.values())
            scores.append((sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / avg)) for w in terms if c[w]), d))
        for r, (s, d) in enumerate(sorted(scores, key=lambda x: (-round(x[0], digits), x[1]))[:k], 1):
            out[q, r] = (d, round(s, 6))
    return out


def corpus(seed, n):
    """Words with a long tail, so that common ones bound little and rare ones decide; copies make ties."""
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.paretovariate(0.6)) - 1, 400)}"
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(20)] + [(n + 50, None), (n + 51, ""), (n + 52, "nothing shared")]
    queries = [(q, " ".join(["w0", "w1", *(word() for _ in range(r.randrange(8)))])) for q in range(25)] + [(90, None), (91, "unknown"), (92, "w0"), (93, "w0 w0 w399 w7")]
    return docs, queries


@pytest.mark.parametrize("k", [1, 5, 400])
def test_bounded_search_equals_plain_scores(spark, k):
    docs, queries = corpus(k, 200)
    table, asked = spark.createDataFrame(docs, "d long, t string").repartition(5), spark.createDataFrame(queries, "q long, t string")
    got = {(r["q"], r["rank"]): (r["d"], round(r["score"], 6)) for r in lexical.search(table, asked, "d", "t", "q", "t", k, digits=9).collect()}
    assert got == plain(docs, queries, k)


def test_search_within_some_documents_and_by_a_stored_index(spark):
    docs, queries = corpus(9, 150)
    table, asked = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(queries, "q long, t string")
    some = spark.createDataFrame([(i,) for i in range(0, 170, 3)] * 2, "d long")
    rows = lambda df: {(r["q"], r["rank"]): (r["d"], round(r["score"], 6)) for r in df.collect()}
    assert rows(lexical.search(table, asked, "d", "t", "q", "t", 4, digits=9, within=some)) == plain(docs, queries, 4, within=set(range(0, 170, 3)))
    folder = scratch(spark)
    n, _ = lexical.write_index(table, "d", "t", folder)
    found = lexical.search_index(spark, folder, n, asked, "d", "q", "t", 4, digits=9)
    assert n == len(docs) and rows(found) == plain(docs, queries, 4)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "d long, t string"), spark.createDataFrame([(1, "a b")], "d long, t string")
    assert lexical.search(none, one.toDF("q", "t"), "d", "t", "q", "t", 3).count() == 0
    assert lexical.search(one, none.toDF("q", "t"), "d", "t", "q", "t", 3).count() == 0


def test_common_terms_are_only_looked_up(spark):
    """With a rare term that decides, the common term's postings are not scored for every document."""
    docs = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i < 3 else "")) for i in range(500)]
    table, asked = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame([(1, "common rare")], "q long, t string")
    found = lexical.search(table, asked, "d", "t", "q", "t", 2)
    assert [r["d"] for r in found.orderBy("rank").collect()] == [d for d, _ in [plain(docs, [(1, "common rare")], 2)[1, r] for r in (1, 2)]]


@pytest.mark.parametrize("keep_self", [True, False])
def test_cosine_search_equals_plain_scores(spark, keep_self):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(300)] + [(300, None), (301, [0.0] * 6)]
    table = spark.createDataFrame(vectors, "d long, v array<double>").repartition(4)
    asked = table.where("d % 10 = 0").select(F.col("d").alias("q"), "v")
    got = {(x["q"], x["rank"]): (x["d"], round(x["score"], 6)) for x in dense.search(table, asked, "d", "v", "q", 7, keep_self, digits=9).collect()}
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in vectors if v is not None}
    want = {}
    for q in (i for i in unit if i % 10 == 0):
        scores = sorted(((-round(float(unit[q] @ u), 9) + 0.0, i) for i, u in unit.items() if keep_self or i != q))
        want |= {(q, n): (i, round(-s, 6)) for n, (s, i) in enumerate(scores[:7], 1)}
    assert got == want


def test_queries_with_the_same_terms_are_scored_once(spark):
    docs, _ = corpus(4, 120)
    queries = [(q, f"w{q // 2} w{q // 2 % 7} W0 w0" if q % 2 else f"w0 w{q // 2 % 7}, w{q // 2}") for q in range(1300)]
    table, asked = spark.createDataFrame(docs, "d long, t string").repartition(3), spark.createDataFrame(queries, "q long, t string")
    assert lexical.Asked(asked, "q", "t").sets.count() == 650
    got = {(r["q"], r["rank"]): (r["d"], round(r["score"], 6)) for r in lexical.search(table, asked, "d", "t", "q", "t", 3, digits=9).collect()}
    assert got == plain(docs, queries, 3)


def test_scores_and_products_are_not_joined_by_term(spark):
    """Neither the search nor the products join postings with queries; texts of one id are one document."""
    docs = [(1, "a b a"), (2, "b"), (1, "c"), (3, None)]
    table, asked = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame([(7, "A c b"), (8, "zzz")], "q long, t string")
    found = lexical.dots(table, asked, "d", "t", "q", "t")
    assert sorted(map(tuple, found.collect())) == [(7, 1, 4), (7, 2, 1)]
    assert "term" not in str(found._jdf.queryExecution().optimizedPlan()).split("MapInArrow")[0]


@pytest.mark.parametrize("share", [0, 1 / 8, 1])
def test_sums_hang_neither_on_matrices_nor_on_blocks(monkeypatch, share):
    """Common terms are multiplied, rare ones added pair by pair; the sums of whole numbers are exact either way."""
    r = np.random.default_rng(5)
    monkeypatch.setattr(lexical, "DENSE", share)
    monkeypatch.setattr(lexical, "ASKS", 7)
    held = [(q, [f"t{w}" for w in sorted(set((r.pareto(0.7, 12)).astype(int) % 60))]) for q in range(30)]
    numbers, words, factor, parts, often, most = lexical.Asked._block(held, {f"t{w}": 1.0 + w for w in range(60)})
    has = r.random((len(words), 40)) < r.random((len(words), 1))
    code, at = np.nonzero(has)
    mixed = r.permutation(len(code))
    add = r.integers(1, 1 << 45, len(code)).astype(float)
    place = {w: k for k, w in enumerate(words.to_pylist())}
    weight = np.zeros(has.shape)
    weight[code, at] = add
    want = np.array([weight[[place[w] for w in own]].sum(axis=0) for _, own in held])
    got = dict(lexical._block_scores(code[mixed], at[mixed], add[mixed], 40, often, len(numbers), parts))
    assert np.array_equal(np.concatenate([got[p] for p in range(len(parts))]), want)
    assert most >= max(sum(factor[place[w]] for w in own) for _, own in held) * 2.2 - 1e-6


def test_interval_asks_what_it_reports(spark, monkeypatch):
    """The interval is of the last question as it is, so only that and the answer are searched."""
    from scholia.plans import evaluation

    seen, search = [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda docs, queries, *a, **k: seen.append(queries) or search(docs, queries, *a, **k))
    whole = evaluation.retrieval_turns(spark, "/root/testdata/sf0.001").where("source = 'last_turn'")
    got = evaluation.p3_retrieval_interval(spark, "/root/testdata/sf0.001").collect()
    kinds = [{x[0] for x in q.select(F.split("ask", "/")[0]).distinct().collect()} for q in seen]
    assert kinds == [{"answer", "last_turn", "with_history", "rewrite"}, {"answer", "last_turn"}]
    assert got == evaluation.stats.family_bootstrap(whole, "conv_id", "ndcg10", seed=42).collect()


ODD = ["Ab1 c-d", "", None, "  ", "İstanbul \u212a9 ﬁn①x", "naïve e\u0301x", "x\x00y\tz", "ẞTRASSE ÅB", "９9 Ⅷ", "end"]


def test_terms_of_batches_equal_the_column_functions(spark):
    """Terms found in Arrow batches are those of the column functions; index builds do not match a pattern at every letter."""
    from scholia.functions.text import token_arrays, tokens
    from scholia.operators import evidence

    rows = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    for compatible, column in ((False, tokens(F.col("text"))), (True, lexical.terms(F.col("text")))):
        want = [r[0] or [] for r in rows.orderBy("id").select(column).collect()]
        flat, length = token_arrays(ODD, compatible)
        ends = length.cumsum().tolist()
        assert [flat.to_pylist()[e - n : e] for e, n in zip(ends, length.tolist(), strict=True)] == want
    for built in (lexical.counted(rows, "id", "text"), evidence.fixture_embedding(rows, "id", "text")):
        assert "regexp_extract_all" not in built._jdf.queryExecution().toString()
    assert [(r.x, r.y) for r in evidence.fixture_embedding(rows, "id", "text").orderBy("id").collect()][1:4] == [(1.0, 0.0)] * 3
