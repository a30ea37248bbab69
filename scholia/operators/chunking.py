"""Chunkers: fixed windows, table parts, paragraph packing, overlap merging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.readers import bounded_batches

TARGET, MAXIMUM, CARRY = 200, 320, 2
# Fixed values of the chunk policy.
ABBREVIATIONS = {
    "al", "e.g", "i.e", "eg", "ie", "fig", "figs", "eq", "eqs", "ref", "refs", "sec", "secs", "tab", "tabs", "cf", "vs", "etc", "approx", "resp", "no",
    "dr", "prof", "mr", "mrs", "ms", "st", "inc", "ltd", "jr", "sr", "vol",
}
SHORT_LINE = 0.85


def fixed_windows(docs: DataFrame, key: str, text: str, target: int, overlap: int) -> DataFrame:
    """(key, ordinal, token_count, chunk): windows of target words, the last being the first that reaches the end."""
    step = target - overlap
    own = docs.select(key, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    last = F.greatest(F.ceil((n - target) / F.lit(float(step))), F.lit(0)).cast("int")
    rows = own.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    piece = F.slice("w", F.col("ordinal") * step + 1, F.lit(target))
    return rows.select(key, "ordinal", F.size(piece).cast("long").alias("token_count"), F.array_join(piece, " ").alias("chunk"))


def table_parts(docs: DataFrame, key: str, text: str, cap: int) -> DataFrame:
    """A text within the cap stays whole; a longer one is cut without overlap and labelled part i/n."""
    parts = fixed_windows(docs, key, text, cap, 0)
    n = docs.select(key, F.greatest(F.ceil(F.size(words(F.col(text))) / F.lit(float(cap))), F.lit(1)).cast("int").alias("n"))
    label = F.when(F.col("n") > 1, F.format_string("part %d/%d", F.col("ordinal") + 1, F.col("n")))
    return parts.join(n, key).select(key, "ordinal", "token_count", label.alias("fragment"))


def ends_sentence(text: str) -> bool:
    """Whether a text ends like a sentence: not after an abbreviation, an initial or a number with its point."""
    bare = text.rstrip("\"')]").rstrip()
    if not bare.endswith("."):
        return bare.endswith(("!", "?"))
    m = re.search(r"[\w.]+$", bare[:-1])
    last = m[0].lower().rstrip(".") if m else None
    return last is None or not (last in ABBREVIATIONS or last.isdigit() or len(last) == 1)


def split_sentences(text: str) -> list[str]:
    """Cut after . ! ? (closing quotes and brackets behind it go) before white space, where a sentence ends."""
    flat, out, start = " ".join(text.split()), [], 0
    for m in re.finditer(r"[.!?](?=([\"')\]]*\s))", flat):
        if ends_sentence(flat[start : m.end()]):
            out.append(flat[start : m.end()].strip())
            start = m.end(1)
    return [*out, flat[start:].strip()] if flat[start:].strip() else out


def split_paragraphs(text: str) -> list[str]:
    """At blank lines if there are any; else a line much shorter than the median that ends a sentence closes a paragraph."""
    if re.search(r"\n\s*\n", text):
        return [" ".join(p.split()) for p in re.split(r"\n\s*\n", text) if p.strip()]
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) < 3:
        return [" ".join(lines)] if lines else []
    short = SHORT_LINE * median(map(len, lines))
    last = [len(x) < short and ends_sentence(x) for x in lines]
    starts = [0, *(k + 1 for k, end in enumerate(last) if end)]
    return [" ".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True) if b > a]


def pack_paragraphs(text: str, target: int = TARGET, maximum: int = MAXIMUM, carry: int = CARRY) -> list[str]:
    """Sentences packed in order: a chunk closes at target words or when the next paragraph's sentence would pass the maximum; up to `carry` sentences of at most a quarter of the maximum repeat in the next."""
    chunks: list[list[str]] = []
    own: list[str] = []
    size = lambda many: sum(len(x.split()) for x in many)

    def close():
        nonlocal own
        chunks.append(own)
        back: list[str] = []
        for s in reversed(own[-carry:] if carry else []):
            if size([s, *back]) > maximum // 4 or len(back) + 1 >= len(own):
                break
            back.insert(0, s)
        own = back

    fresh = 0
    for paragraph in split_paragraphs(text):
        for sentence in split_sentences(paragraph):
            tokens = sentence.split()
            for k in range(0, len(tokens), maximum):
                piece = " ".join(tokens[k : k + maximum])
                if fresh and size(own) + len(piece.split()) > maximum:
                    close()
                    fresh = 0
                    if size(own) + len(piece.split()) > maximum:
                        own = []
                own.append(piece)
                fresh += 1
        if fresh and size(own) >= target:
            close()
            fresh = 0
    if fresh:
        chunks.append(own)
    return [" ".join(c) for c in chunks]


def packed(docs: DataFrame, key: str, text: str, target: int = TARGET, maximum: int = MAXIMUM, carry: int = CARRY) -> DataFrame:
    """(key, ordinal, token_count, chunk) of paragraph packing; sequential within a text, so in Arrow batches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(k, i, len(c.split()), c) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, c in enumerate(pack_paragraphs(t or "", target, maximum, carry))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_pydict({key: pa.array(cols[0], pa.int64()), "ordinal": pa.array(cols[1], pa.int32()), "token_count": pa.array(cols[2], pa.int64()), "chunk": pa.array(cols[3], pa.string())})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, f"{key} long, ordinal int, token_count long, chunk string")


def replaced(store: DataFrame, fresh: DataFrame, version: str) -> DataFrame:
    """The store with all chunks of every version in `fresh` replaced by those there."""
    return store.join(fresh.select(version).distinct(), version, "left_anti").unionByName(fresh)


def merge_overlap(left: str, right: str, most: int = 400) -> str:
    """right appended to left without the longest suffix of left's words that right starts with."""
    a, b = left.split(), right.split()
    for n in range(min(len(a), len(b), most), 0, -1):
        if a[-n:] == b[:n]:
            return " ".join(a + b[n:])
    return " ".join(a + b)


def reconstructed(chunks: DataFrame, key: str, most: int = 400) -> DataFrame:
    """(key, text), overlaps of up to `most` words taken out, from the chunks of each document in order; a document's chunks meet in one row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = []
            for own in part.column(1).to_pylist():
                out = ""
                for chunk in own:
                    out = merge_overlap(out, chunk, most) if out else chunk
                texts.append(out)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    bounded_batches(chunks.sparkSession)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk"))), lambda r: r["chunk"])
    return chunks.groupBy(key).agg(ordered.alias("rows")).mapInArrow(run, f"{key} {chunks.schema[key].dataType.simpleString()}, text string")
