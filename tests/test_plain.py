"""Queries without SQL against plain Python over the same tables."""

import os
import re
import unicodedata

import pytest

from scholia.functions import text as T
from scholia.operators import chunking
from scholia.plans import catalog

FOLDER = os.environ.get("SCHOLIA_TABLES", "/root/testdata/sf0.001")
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r["item_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def tokens(t):
    return re.findall("[0-9a-z]+", t.lower())


def sentences(t):
    lines = [x for x in t.split("\n") if not x.lstrip(" ").startswith("#")]
    parts = [" ".join(tokens(p)) for x in lines for p in re.split(r"(?<=[.!?])\s+", x)]
    return [p for p in parts if 3 <= len(p.split()) <= 120]


def longest(wanted, chunk):
    run = best = 0
    for s in wanted:
        run = run + 1 if f" {s} " in f" {chunk} " else 0
        best = max(best, run)
    return best


def test_characters_that_normalisation_leaves_alone():
    """The set of the short cut holds no character that changes, nor any mark that could join the one before it."""
    stable = re.compile(T._STABLE.replace("\\x", "\\x").encode().decode("unicode_escape"))
    found = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and stable.match(c) and c != "\n"]
    assert len(found) > 30_000
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and not unicodedata.category(c).startswith("M") for c in found)


def test_lexical_terms_are_normalised(spark):
    from pyspark.sql import functions as F

    from scholia.operators import lexical

    odd = ["ﬁne ﬁﬁ", "ｆｕｌｌ ｗｉｄｔｈ", "x² H₂O", "Ⅻ ½", "plain", "éte", "각", None]
    got = [r["w"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").orderBy("k").select(lexical.terms(F.col("t")).alias("w")).collect()]
    assert got == [None if t is None else re.findall("[0-9a-z]+", unicodedata.normalize("NFKC", t).lower()) for t in odd]


def test_h2_spans(spark, texts):
    for r in rows(spark, "h2_whitespace_spans"):
        assert [tuple(x) for x in r["spans"]] == [m.span() for m in re.finditer(r"\S+", texts[r["doc_id"]])]


def test_h18_runs(spark, items):
    got = {r["item_id"]: r["run"] for r in rows(spark, "h18_longest_run")}
    assert got == {i: longest(sentences(t), " ".join(tokens(t))) for i, t in items.items()} and any(got.values())


def test_h27_history_by_hand(spark):
    turns = [(1, 0, "user", "old  words"), (1, 1, "assistant", "yes"), (1, 2, "user", "and\nnow?"), (2, 0, "user", "x"), (2, 1, "assistant", None)]
    table = spark.createDataFrame(turns, "c int, n int, role string, text string")
    whole = {1: "User: old words\nAssistant: yes\nUser: and now?", 2: "User: x\nAssistant:"}

    def plain(t, limit):
        return t[-limit:].removeprefix("\n") if limit < len(t) else t

    for limit in (5, 14, 15, 16, 25, 30, 31, 100):
        got = {r["c"]: r["history"].rstrip() for r in T.format_history(table, "c", "n", "role", "text", limit).collect()}
        assert got[1] == plain(whole[1], limit)
    assert got[2] == whole[2]


def test_j11_and_j14_chunks(spark, texts):
    got = {r["doc_id"]: (r["before"], r["after"], r["chunks"], r["skipped"]) for r in rows(spark, "j11_rechunk_with_guard")}
    for i, t in texts.items():
        chunks = chunking.pack_paragraphs(t)
        if chunks:
            after = sum(len(c.split()) for c in chunks)
            assert got[i] == (len(t.split()), after, len(chunks), after > 1.6 * len(t.split()))
    found = {(r["doc_id"], r["ordinal"]): r["run"] for r in rows(spark, "j14_gold_chunks")}
    want = {}
    for i, t in texts.items():
        w, first = t.split(), sentences(t)[:4]
        for o in range(-(-max(len(w) - 128, 0) // 112) + 1 if w else 0):
            run = longest(first, " ".join(tokens(" ".join(w[o * 112 : o * 112 + 128]))))
            if run >= 2:
                want[i, o] = run
    assert found == want and want


def test_i17_sections(spark, texts):
    got = {(r["doc_id"], r["ordinal"]): (r["chunks"], r["text"]) for r in rows(spark, "i17_expand_to_section")}
    want = {}
    for i, t in texts.items():
        chunks = chunking.pack_paragraphs(t, 60, 100, 0)
        size = lambda some: sum(len(c) + 2 for c in some)
        for o in range(3, len(chunks), 7):
            taken = [o]
            if size(chunks) - 2 <= 1500:
                taken = list(range(len(chunks)))
            else:
                for more in (range(o + 1, len(chunks)), range(o - 1, -1, -1)):
                    for k in more:
                        if size([chunks[j] for j in taken]) + len(chunks[k]) > 1500:
                            break
                        taken.append(k)
            want[i, o] = (len(taken), "\n\n".join(chunks[k] for k in sorted(taken)))
    assert got == want and want


def test_i16_evidence(spark, texts, items):
    """Floor, caps, word budget and labels, from the ranked candidates on."""
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source").collect()}
    from scholia.plans import retrieval
    from scholia.plans.registry import Tables

    ranked = {}
    for r in retrieval.bm25(Tables(spark, FOLDER), 40).collect():
        ranked.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"]))
    want = {}
    for item, docs in ranked.items():
        q = set(tokens(items[item]))
        scored = sorted(((-len(q & set(tokens(texts[d]))) / len(q), rank, d) for rank, d in docs))
        by, taken, used = {}, [], 0
        few = []
        for s, _, d in scored:
            if -s >= 0.1 and by.get(source[d], 0) < 3 and len(few) < 12:
                by[source[d]] = by.get(source[d], 0) + 1
                few.append(d)
        for d in few:
            if used + len(tokens(texts[d])) <= 2000:
                used += len(tokens(texts[d]))
                taken.append((d, used))
        want |= {(item, f"E{k}"): (d, u) for k, (d, u) in enumerate(taken, 1)}
    assert {(r["item_id"], r["label"]): (r["doc_id"], r["used"]) for r in rows(spark, "i16_retrieve")} == want and want
