"""Unit tests of library functions with known answers and edge cases."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from scholia.functions import rules, stats, text
from scholia.operators import chunking, dense, evidence, identity, lexical, metrics, pages, ranking
from scholia.sources import readers
from scholia.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,doi", [("10.1234/AbC", "10.1234/abc"), (" https://doi.org/10.1234/x ", "10.1234/x"), ("doi: 10.99999/y", "10.99999/y"), ("11.1/x", None), ("10.12/x", None)])
def test_doi(spark, raw, doi):
    assert one(spark, text.normalize_doi(F.lit(raw))) == doi


def test_arxiv_and_uuid(spark):
    assert tuple(one(spark, text.normalize_arxiv(F.lit("https://arxiv.org/abs/2101.00001v3")))) == ("2101.00001", 3)
    assert one(spark, text.normalize_arxiv(F.lit("nothing"))) is None
    assert one(spark, text.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.lit("a|b"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a|b"))


def test_nfkc_and_titles(spark):
    rows = spark.createDataFrame([("ﬁne Ｔitle",), ("Straße  x",), ("  ",), (None,), ("plain",)], "t string")
    got = [r.k for r in rows.select(text.title_key(F.col("t"), exact=True).alias("k")).collect()]
    assert got == ["fine title", "strasse x", None, None, "plain"]


def test_tracks_and_filters(spark):
    assert tuple(one(spark, rules.classify_track(F.lit("  Oral   Presentation")))) == ("main", "accepted")
    assert one(spark, rules.normalize_decision(F.lit("Oral Presentation (Withdrawn)"))) == "withdrawn"
    with pytest.raises(ValueError):
        rules.payload_filter(F.lit(1), F.lit("a"), 5, 4)
    assert one(spark, rules.payload_filter(F.lit(None).cast("int"), F.lit("a"), low=1)) is False


def test_statistics(spark):
    p = one(spark, stats.exact_binomial(F.lit(1), F.lit(9)))
    assert p == pytest.approx(2 * (1 + 10) / 2**10)
    assert one(spark, stats.exact_binomial(F.lit(0), F.lit(0))) == 1
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0, 1)
    assert one(spark, stats.cohen_kappa(F.lit(5), F.lit(0), F.lit(5), F.lit(5), F.lit(5))) == 1
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0)], "f string, v double")
    b = stats.family_bootstrap(rows, "f", "v", 1, 200).first()
    assert b["mean"] == pytest.approx(2.25) and b["low"] <= b["mean"] <= b["high"]


def test_fusion_and_budget(spark):
    rows = spark.createDataFrame([(1, 7, "a", 1), (1, 7, "a", 3), (1, 8, "a", 2), (1, 8, "b", 1)], "q int, d int, b string, rank int")
    got = ranking.fuse(rows, "q", "d", "b").collect()
    assert [(r.d, round(r.score, 9)) for r in got] == [(8, round(1 / 62 + 1 / 61, 9)), (7, round(1 / 61, 9))]
    with pytest.raises(ValueError):
        ranking.fuse(rows, "q", "d", "b", k=0)
    items = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 40)], "q int, i int, t int")
    assert [(r.position, r.item, r.used) for r in ranking.fill_budget(items, "q", F.col("i"), F.col("i"), F.col("t"), 100).collect()] == [(1, 1, 50), (2, 3, 90)]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "d int, t string")
    asked = spark.createDataFrame([(1, "a A zzz"), (2, ""), (3, "b")], "q int, t2 string")
    got = lexical.search(docs, asked, "d", "t", "q", "t2", 10).collect()
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    weight = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.25))
    assert {(r.q, r.d): round(r.score, 9) for r in got} == {(1, 1): round(idf(1) * weight(2, 3), 9), (3, 1): round(idf(2) * weight(1, 3), 9), (3, 2): round(idf(2) * weight(1, 2), 9)}


def test_dense_and_fixture_embedding(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None)], "d long, v array<float>")
    got = dense.search(v, v.where("d = 1").withColumnRenamed("d", "q"), "d", "v", "q", 2, keep_self=False).collect()
    assert [(r.d, round(r.score, 6), r["rank"]) for r in got] == [(3, 0.707107, 1), (2, 0.0, 2)]
    e = {r.d: (r.x, r.y) for r in evidence.fixture_embedding(spark.createDataFrame([(1, "x"), (2, "")], "d int, t string"), "d", "t").collect()}
    assert e[2] == (1, 0) and math.hypot(*e[1]) == pytest.approx(1)


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (2, 12, 1)], "q int, d int, rank int")
    qrels = spark.createDataFrame([(1, 11, 3), (1, 13, 1), (2, 12, 0), (3, 14, 1)], "q int, d int, grade int")
    got = {r.q: r for r in metrics.evaluate(run, qrels, "q", "d", 5).collect()}
    ideal = 7 + 1 / math.log2(3)
    assert got[1].ndcg == pytest.approx(7 / math.log2(3) / ideal) and got[1].recall == 0.5 and got[1].mrr == 0.5 and got[1].judged == 0.5
    assert got[2].ndcg == 0 and got[2].recall is None and got[2].judged == 1 and got[3].recall == 0


def test_rerank_keeps_order_on_bad_scores(spark):
    head = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (2, 1, float("nan")), (2, 2, 0.9)], "q int, rank int, s double")
    got = {(r.q, r["rank"]): r.position for r in evidence.rerank(head, "q", F.col("s"), 5).collect()}
    assert got == {(1, 2): 1, (1, 1): 2, (2, 1): 1, (2, 2): 2}


def test_chunkers(spark):
    assert chunking.split_sentences("See Fig. 3, i.e. this. Next one! By J. Doe? Yes") == ["See Fig. 3, i.e. this.", "Next one!", "By J. Doe?", "Yes"]
    assert chunking.split_paragraphs("a b.\n\nc d") == ["a b.", "c d"]
    body = " ".join(f"Word{k} goes here now." for k in range(300))
    parts = chunking.pack_paragraphs(body, 100, 120, 0)
    assert " ".join(parts) == body and all(len(p.split()) <= 120 for p in parts)
    assert chunking.merge_overlap("a b c", "b c d") == "a b c d"
    docs = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, "one")], "d long, t string")
    got = sorted((r.d, r.ordinal, r.token_count) for r in chunking.fixed_windows(docs, "d", "t", 10, 2).collect())
    assert got == [(1, 0, 10), (1, 1, 10), (1, 2, 9), (3, 0, 1)]


def test_components_and_roots(spark):
    edges = spark.createDataFrame([(2, 3), (3, 9), (9, 1), (5, 6)], "u int, v int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 7, 9)], "id int")
    assert {r.id: r.root for r in identity.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 7}
    links = spark.createDataFrame([(4, 3), (3, 2), (2, 1)], "id int, target int")
    assert {r.id: (r.root, r.hops) for r in identity.follow_roots(links).collect()} == {4: (1, 3), 3: (1, 2), 2: (1, 1)}


def test_snapshot_is_verified(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "d int, t string")
    assert tuple(readers.write_snapshot(rows, f"{tmp_path}/s", "d", "t").first()) == (2, 2, 1)
    assert readers.read_snapshot(spark, f"{tmp_path}/s", "t").count() == 2
    rows.withColumn("text_sha256", F.lit("no")).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="digest"):
        readers.read_snapshot(spark, f"{tmp_path}/bad", "t").collect()


def test_jsonl_rejects_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# note\n\n{"a": 1}\n{oops\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").collect()


def test_streams(spark, tmp_path):
    rows = [(1, "lease", "2024-01-01 00:00:00"), (1, "fail", "2024-01-01 00:01:00"), (1, "lease", "2024-01-01 00:02:00"), (1, "complete", "2024-01-01 00:03:00"), (2, "lease", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "job int, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cost", F.lit(2.0)).write.parquet(f"{tmp_path}/log")
    schema = "job int, kind string, ts timestamp, cost double"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
    got = stateful.to_table(stateful.job_states(stream(), "job", "ts", "kind"), "job_states", "update").collect()
    assert {(r.job, r.status, r.attempts) for r in got} >= {(1, "done", 2), (2, "running", 1)}
    days = stateful.to_table(stateful.daily_spend(stream(), "ts", "job", "cost"), "daily", "complete").collect()
    assert {(r.job, r.n, r.total) for r in days} == {(1, 4, 8.0), (2, 1, 2.0)}
    first = stateful.to_table(stateful.first_enqueue(stream(), "ts", "job"), "firsts").collect()
    assert sorted(r.job for r in first) == [1, 2]
    batch = spark.read.parquet(f"{tmp_path}/log")
    assert tuple(stateful.capped_spend(batch, ["job"], ["ts"], F.col("cost"), 5.0).where("job = 1").first()) == (1, 4.0, 2, 2)


def test_sentences_and_paragraphs():
    text = 'See Fig. 3 of Smith et al. for it. J. Doe said "yes." Then 0.5 was\nenough! Is it? Yes (it is.) End'
    assert chunking.split_sentences(text) == ["See Fig. 3 of Smith et al. for it.", 'J. Doe said "yes.', "Then 0.5 was enough!", "Is it?", "Yes (it is.", "End"]
    assert chunking.split_sentences("It was 3. Then more. A b. C d.") == ["It was 3. Then more.", "A b. C d."]
    long = "word " * 12
    assert chunking.split_paragraphs(f"{long}\n{long}\nends here.\n{long}\n{long}") == [f"{long.strip()} {long.strip()} ends here.", f"{long.strip()} {long.strip()}"]
    assert chunking.split_paragraphs("a\nb\n \n c  d") == ["a b", "c d"] and chunking.split_paragraphs("") == []


def test_pages_are_repaired():
    many = [f"Journal of things {k}\n{c * 9}\nwell-known methods\nthe well-\nknown and infor-\nmation ﬁeld\0\nlast {c * 9}\n{k}" for k, c in enumerate("abcd")]
    assert pages.clean_pages(many) == [f"{c * 9}\nwell-known methods\nthe well-known and information field\nlast {c * 9}" for c in "abcd"]
    assert pages.clean_pages(many[:2])[0].startswith("Journal of things 0")


HEADINGS = {
    "ABSTRACT": ("Abstract", "abstract"), "1 I NTRODUCTION": ("INTRODUCTION", "body"), "2.1. Method and Data": ("Method and Data", "body"), "7 References": ("References", "references"),
    "Table 3: Results": ("Table 3: Results", "table"), "figure 2a. Overview": ("figure 2a. Overview", "figure"), "Appendix B. Proofs": ("Appendix B. Proofs", "appendix"), "Acknowledgements.": ("Acknowledgments", "acknowledgments"),
    "2. Barron, J.T., Mildenhall, B.": None, "3 Rows with 12 cells": None, "4 GPT-4 results": ("GPT-4 results", "body"), "5 This ends.": None, "plain text": None, "1 " + "A" * 95: None,
}


def test_headings(spark):
    assert {k: pages.heading(k) for k in HEADINGS} == HEADINGS
    got = spark.createDataFrame([(k,) for k in HEADINGS], "line string").select("line", pages.heading_kind(F.col("line")).alias("kind")).collect()
    assert {r.line: r.kind for r in got} == {k: v and v[1] for k, v in HEADINGS.items()}


def test_sections():
    text = [
        (1, "A Title\nAbstract\nWe do it.\n1 Introduction\nIt begins here and goes on for a while, so that it is no fragment at all."),
        (2, "Figure 1: What is seen\nin two lines.\nand goes on after the figure.\nTable 2: One line.\nThe end of it.\n2 Bits\ntiny"),
        (3, "Appendix A\nproof\n3 More Proofs\nThis is a body heading inside the appendix, and long enough to stay apart."),
    ]
    raw = pages.raw_sections(text)
    assert [(s.name, s.kind, s.first, s.last) for s in raw] == [
        ("Front matter", "front", 1, 1), ("Abstract", "abstract", 1, 1), ("Introduction", "body", 1, 1), ("Figure 1: What is seen", "figure", 2, 2), ("Introduction", "body", 2, 2),
        ("Table 2: One line.", "table", 2, 2), ("Introduction", "body", 2, 2), ("Bits", "body", 2, 2), ("Appendix A", "appendix", 3, 3), ("More Proofs", "appendix", 3, 3),
    ]
    merged = pages.merged_sections(raw)
    assert [(s.name, s.first, s.last, len(s.lines)) for s in merged] == [
        ("Front matter", 1, 1, 1), ("Abstract", 1, 1, 1), ("Introduction", 1, 2, 4), ("Figure 1: What is seen", 2, 2, 2), ("Table 2: One line.", 2, 2, 1), ("Appendix A", 3, 3, 1), ("More Proofs", 3, 3, 1),
    ]
