"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive words of a benchmark item (a shorter item is one window) goes
into one automaton over normalised text; each document is normalised the same way and scanned
once.  Matches are whole words because patterns and texts carry a space before and after each
word.  Hit words map back to character spans of the original text.

The benchmark is read to the driver in blocks of AUTOMATON_BYTES of text.  One block is the usual
case: its windows are broadcast and nothing is shuffled.  Of a larger benchmark one block after
the other is broadcast, scanned for, written and given up; what was found is kept by text hash
and joined at the end, so memory is that of one automaton, whatever the benchmark's size.

Defined results: null or empty texts have no words and are not contaminated; an item without
words has no window; the same window in several items counts for each of them; an item without
an id hits words but is not counted or named; repeated rows give repeated results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut, plain_text, texts_of
from .units import kept_in_worker

WORDS_PER_WINDOW = 10
#: Bytes of benchmark text in one automaton (about 60 times as much memory).
AUTOMATON_BYTES = 1 << 22

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, hit_words array<array<long>>, hit_spans array<array<long>>"
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def window_table(items: list[tuple[str | None, bytes]], size: int = WORDS_PER_WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Normalised window -> (its words, the items that have it)."""
    table: dict[str, tuple[int, dict]] = {}
    for item, raw in items:
        words = plain_text(raw).split()
        for k in range(max(len(words) - size + 1, 1) if words else 0):
            w = words[k : k + size]
            table.setdefault(f" {' '.join(w)} ", (len(w), {}))[1][item] = None
    return {k: (n, [x for x in v if x is not None]) for k, (n, v) in table.items()}


def _automaton(table):
    import ahocorasick

    found = ahocorasick.Automaton()
    for window, value in table.items():
        found.add_word(window, value)
    if len(found):
        found.make_automaton()
    return found


def scan(text: str, found) -> tuple[int, np.ndarray, list[str]]:
    """Words of the normalised text, which of them are hit, and the items found."""
    n_words = text.count(" ") - 1 if text else 0
    hits = list(found.iter(text)) if n_words and len(found) else []
    if not hits:
        return n_words, np.zeros(0, bool), []
    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    edge = np.zeros(n_words + 1, np.int64)
    last = np.searchsorted(gaps, [end for end, _ in hits])  # the words before the closing space
    size = np.array([n for _, (n, _) in hits])
    np.add.at(edge, last - size, 1)
    np.add.at(edge, last, -1)
    return n_words, np.cumsum(edge[:-1]) > 0, list(dict.fromkeys(x for _, (_, own) in hits for x in own))


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _window_tables(benchmark: DataFrame, item_col: str, item_text_col: str, size: int) -> Iterator[dict]:
    """The windows of one block of items after the other."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("i"), benchmark[item_text_col].cast("string").alias("t")).where("t is not null")
    block: list[tuple[str | None, bytes]] = []
    held = 0
    for row in items.toLocalIterator():
        raw = row.t.encode()
        if block and held + len(raw) > AUTOMATON_BYTES:
            yield window_table(block, size)
            block, held = [], 0
        block.append((row.i, raw))
        held += len(raw)
    yield window_table(block, size)


def _joined(spans: list[list[list[int]]]) -> list[list[int]]:
    """Runs of several scans as one."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, (x for own in spans for x in own))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _rows_of(key, texts: list[bytes], words: list[int], items: list[list[str]], hits: list[list[list[int]]]) -> pa.RecordBatch:
    spans = []
    for raw, where in zip(texts, hits, strict=True):
        at = [m.span() for m in _WORD.finditer(raw.decode())] if where else []
        spans.append([[at[a][0], at[b - 1][1]] for a, b in where])
    pairs = pa.list_(pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict({
        "doc_id": key, "n_words": pa.array(words, pa.int64()), "n_hit": pa.array([sum(b - a for a, b in w) for w in hits], pa.int64()),
        "item_ids": pa.array(items, pa.list_(pa.string())), "hit_words": pa.array(hits, pairs), "hit_spans": pa.array(spans, pairs),
    })


FOUND = "h1 long, h2 long, item_ids array<string>, hit_words array<array<long>>"


def _found_by_text(own: DataFrame, tables: Iterator[dict]) -> DataFrame:
    """Block by block, what is found in texts with a hit, by the texts' hashes."""
    spark, found = own.sparkSession, None
    for table in tables:
        shared, name = spark.sparkContext.broadcast(table), uuid.uuid4().hex

        def run(parts: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton = kept_in_worker(name, lambda: _automaton(shared.value))
            for part in parts:
                some = [(k, names, [list(x) for x in runs(hit)]) for k, raw in enumerate(texts_of(part.column(2))) for _, hit, names in [scan(plain_text(raw), automaton)] if len(hit)]
                rows = pa.array([k for k, *_ in some], pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "h1": part.column(0).take(rows), "h2": part.column(1).take(rows),
                    "item_ids": pa.array([x for _, x, _ in some], pa.list_(pa.string())), "hit_words": pa.array([x for *_, x in some], pa.list_(pa.list_(pa.int64()))),
                })

        own_found = cut(own.select("h1", "h2", "text").mapInArrow(run, FOUND).dropDuplicates(["h1", "h2"]), "hits")
        shared.destroy()
        found = own_found if found is None else found.union(own_found)
    return cut(found.groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.flatten(F.collect_list("hit_words")).alias("hit_words")), "hits")


def _hashed(docs: DataFrame, text) -> DataFrame:
    return docs.withColumns({"_scholia_h1": F.xxhash64(text), "_scholia_h2": F.xxhash64(F.lit(1), text)})


def _first_tables(benchmark: DataFrame, item_col: str, item_text_col: str, size: int) -> tuple[dict, Iterator[dict] | None]:
    """The first block's windows, and all blocks if there are more."""
    tables = _window_tables(benchmark, item_col, item_text_col, size)
    first, second = next(tables), next(tables, None)
    return first, None if second is None else chain([first, second], tables)


def without_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WORDS_PER_WINDOW) -> DataFrame:
    """The rows of docs in which no word is hit, all columns as they are."""
    first, tables = _first_tables(benchmark, item_col, item_text_col, size)
    text = docs[text_col].cast("string")
    if tables is not None:
        hashed = _hashed(docs, text)
        found = _found_by_text(hashed.select(F.col("_scholia_h1").alias("h1"), F.col("_scholia_h2").alias("h2"), F.col(text_col).cast("string").alias("text")), tables)
        names = found.select(F.col("h1").alias("_scholia_h1"), F.col("h2").alias("_scholia_h2"))
        return hashed.join(names, ["_scholia_h1", "_scholia_h2"], "left_anti").select(*docs.columns)
    shared, name = docs.sparkSession.sparkContext.broadcast(first), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        automaton = kept_in_worker(name, lambda: _automaton(shared.value))
        return pd.Series([not len(scan(plain_text(b"" if t is None else t.encode()), automaton)[1]) for t in texts], dtype="bool")

    return docs.where(clean(text))


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WORDS_PER_WINDOW) -> DataFrame:
    """Per document: words, hit words, items found, hit word runs and their character spans in the original."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    first, tables = _first_tables(benchmark, item_col, item_text_col, size)
    if tables is not None:
        hashed = own.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        found = _found_by_text(hashed, tables)

        def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                texts = texts_of(part.column(1))
                words = [max(plain_text(t).count(" ") - 1, 0) for t in texts]
                yield _rows_of(part.column(0), texts, words, [sorted(x or []) for x in part.column(2).to_pylist()], [_joined([x or []]) for x in part.column(3).to_pylist()])

        return hashed.join(found, ["h1", "h2"], "left").select("doc_id", "text", "item_ids", "hit_words").mapInArrow(describe, SCHEMA)
    shared, name = docs.sparkSession.sparkContext.broadcast(first), uuid.uuid4().hex

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept_in_worker(name, lambda: _automaton(shared.value))
        for part in parts:
            texts = texts_of(part.column(1))
            found = [scan(plain_text(t), automaton) for t in texts]
            yield _rows_of(part.column(0), texts, [n for n, _, _ in found], [sorted(x) for *_, x in found], [[list(x) for x in runs(hit)] for _, hit, _ in found])

    return own.mapInArrow(run, SCHEMA)


def contract(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
