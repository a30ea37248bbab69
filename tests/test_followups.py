"""Follow-up pairs against a plain search over all pairs, and the rules by hand."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scholia.operators import followups
from scholia.sources.readers import scratch


@pytest.mark.parametrize(
    ("title", "first", "second", "rewrite", "problem"),
    [
        ("Fast GraphNet Training", "How does X-Net learn?", "What loss does X-Net use?", "What loss does it use?", None),
        ("Fast GraphNet Training", "How does X-Net learn?", "What loss does X-Net use?", "What loss does x-net use?", "leaks"),
        ("Fast GraphNet Training", "How does it learn?", "What is graphnet for?", "What is graphnet for?", "leaks"),  # a name of the title
        ("On the Training of Large Models", "How?", "Why?", "Is training large enough?", "leaks"),  # two words of the title's content
        ("On the Training of Large Models", "How?", "Why?", "Is large training enough?", None),
        ("A title", "How does X-Net learn?", "Is X-Net better than BERT2 and R?", "Is it better than R?", "drops_subject"),
        ("A title", "How does X-Net learn?", "Is X-Net better than 5?", "Is it better?", None),  # one character is no subject
        ("A title", "How?", "Why?", "  ", "empty"), ("A title", "How?", "Why?", None, "empty"),
    ],
)
def test_rules_by_hand(spark, title, first, second, rewrite, problem):
    row = spark.createDataFrame([(title, first, second, rewrite)], "title string, first string, second string, followup string")
    assert followups.kept(row).first()["problem"] == problem


def plain_pairs(rows, seed):
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    names = lambda t: {w.lower() for w in t.split() if any(c.isdigit() for c in w) or "-" in w or sum(c.isupper() for c in w) > 1}
    out = []
    for paper in {p for p, *_ in rows}:
        own = [(i, t) for p, i, t in rows if p == paper]
        pairs = [((digest(b), b), (digest(a), a)) for a, ta in own for b, tb in own if a != b and names(tb) & {w.lower() for w in ta.split()}]
        if pairs:
            (_, second), (_, first) = min(pairs)
            out.append((paper, first, second))
    return sorted(out)


def test_pairs_equal_a_search_of_all_pairs(spark):
    r = random.Random(3)
    rows = [(r.choice(["p1", "p2", "p3", "hot", "hot", "hot", f"q{k}"]), f"i{k}", " ".join(r.choice(["plain", "words", f"N{r.randrange(30)}", "x-ray", "AbC", "abc", f"n{r.randrange(30)}"]) for _ in range(r.randrange(5)))) for k in range(150)]
    got = followups.pairs_sharing_names(spark.createDataFrame(rows, "paper string, id string, text string").repartition(4), 5)
    assert sorted(map(tuple, got.collect())) == plain_pairs(rows, 5)
    split = followups.split_pairs(got, 5, 2, 2).collect()
    order = sorted((hashlib.sha256(f"5:{p}".encode()).hexdigest(), p) for p, *_ in plain_pairs(rows, 5))
    assert {r["paper"]: r["split"] for r in split} == {p: "development" if k < 2 else "frozen" for k, (_, p) in enumerate(order[:4])}


def test_repeated_rows_are_one_question(spark):
    """Rows that repeat hide no other holder of a word, and make no pair of their own."""
    rows = [("p", "a", "about N1"), ("p", "b", "also N1"), ("p", "c", "and N1"), ("alone", "a", "about N1")]
    got = followups.pairs_sharing_names(spark.createDataFrame(rows * 3, "paper string, id string, text string"), 5)
    assert sorted(map(tuple, got.collect())) == plain_pairs(rows, 5)


def test_registered_texts_are_checked_against_what_was_written(spark):
    rows = [(f"c{k}", "frozen" if k % 2 else "development", f"text {k}") for k in range(6)]
    table = spark.createDataFrame(rows, "conversation_id string, split string, followup string")
    path = scratch(spark)
    followups.register(table, path)
    registered, texts = spark.read.parquet(path), table.select("conversation_id", "followup")
    got = followups.read_registered(registered, texts, "frozen").collect()
    assert sorted(map(tuple, got)) == [(f"c{k}", f"text {k}") for k in (1, 3, 5)]
    changed = texts.withColumn("followup", F.when(F.col("conversation_id") == "c3", "other").otherwise(F.col("followup")))
    with pytest.raises(PySparkException, match="conversation_text_changed:c3"):
        followups.read_registered(registered, changed, "frozen").collect()
    assert followups.read_registered(registered, changed, "development").count() == 3
    with pytest.raises(PySparkException, match="conversation_text_missing:c5"):
        followups.read_registered(registered, texts.where("conversation_id <> 'c5'"), "frozen").collect()
