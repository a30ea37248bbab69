"""Quality rules from word repetition: per-text suffix arrays over words.

For each text a suffix array over its words is built by prefix doubling (only suffixes that are
still tied are sorted again).  The longest common prefix of neighbours gives, for each word
position, the longest stretch starting there that also starts elsewhere in the same text; the
left-maximal ones are the maximal repeated substrings.  Their spans are joined, and a text is
turned down if the joined spans cover too large a share of its characters or if one repeat is
too long.

Defined results: a null or empty text has no words, all counts are 0, base_failed is true and
kept is false; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import SPACED, U64, Block, groups, mix, texts_of

MIN_WORDS = 10
WINDOW = 5
MAX_WINDOW_SHARE = 20  # per cent of the words
MAX_COVERED = 0.2  # share of the characters in words
MAX_LONGEST = 40  # words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, longest_repeat long, covered_chars long, n_maximal long, repeat_spans array<array<long>>"
)


def suffix_array(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffixes in order (as token positions), ranks by level, and each word's token position.

    Tokens are the words of each text followed by an end of its own, so no match leaves a text.
    Words are ordered by hash; any fixed order of the alphabet gives a suffix array.
    """
    n = len(keys)
    at = np.arange(n) + doc
    rank = np.empty(n + n_docs, np.int64)
    ends = np.cumsum(np.bincount(doc, minlength=n_docs) + 1) - 1
    rank[ends] = n + np.arange(n_docs)
    own = keys ^ mix(doc.astype(np.uint64) + U64(0x51ED2701))
    order = np.argsort(own)
    active, levels, step = at[order], [], 1
    rank[active], active = _regroup(own[order], np.zeros(n, np.int64), active, np.zeros(n, np.int64))
    levels.append(rank)
    while len(active):
        old = rank[active]
        key = (old.astype(np.uint64) << U64(32)) | rank[active + step].astype(np.uint64)
        order = np.argsort(key)
        moved, old = active[order], old[order]
        rank = rank.copy()
        heads = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        head = np.repeat(heads, np.diff(np.r_[heads, len(old)]))
        rank[moved], active = _regroup(key[order], head, moved, old)
        levels.append(rank)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank[at]] = at
    return suffixes, levels, at


def _regroup(key, head, moved, old):
    """New ranks of the sorted items and the items that still share theirs."""
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(key)])
    return old + np.repeat(starts, sizes) - head, moved[np.repeat(sizes, sizes) > 1]


def longest_repeats(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each word: the length of the longest stretch from it that starts at another word of the text too."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, np.int64)
    suffixes, levels, at = suffix_array(keys, doc, n_docs)
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    length = np.zeros(len(near), np.int64)
    x, y = a[near].copy(), b[near].copy()
    for k in range(len(levels) - 1, -1, -1):
        more = (levels[k][x] == levels[k][y]).astype(np.int64) << k
        length += more
        x += more
        y += more
    lcp = np.zeros(n + 1, np.int64)
    lcp[near + 1] = length
    most = np.empty(n + n_docs, np.int64)
    most[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return most[at]


def covered(most: np.ndarray, least: int) -> np.ndarray:
    """Words inside any repeat of at least `least` words."""
    edge = np.zeros(len(most) + 1, np.int64)
    first = np.flatnonzero(most >= least)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + most[first], -1)
    return np.cumsum(edge[:-1]) > 0


def rate(texts: list[bytes], max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, window: int = WINDOW) -> dict[str, list]:
    block = Block(texts)
    starts, ends, doc = block.spans(SPACED)
    n_words = np.bincount(doc, minlength=block.n_docs)
    chars = np.r_[0, np.cumsum((block.buf & 0xC0) != 0x80)]
    width = chars[ends] - chars[starts]
    marks = np.r_[0, np.cumsum(SYMBOLS[block.buf])]
    symbols = marks[block.offsets[1:]] - marks[block.offsets[:-1]]

    stops = np.flatnonzero(block.buf == 10)
    begins = np.r_[0, stops[:-1] + 1]
    has_word = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    line_doc = block.doc_of(begins)[has_word]
    line = block.hashes(begins[has_word], stops[has_word])
    distinct = np.unique(line ^ mix(line_doc.astype(np.uint64) + U64(77)), return_index=True)[1]
    dup_lines = np.bincount(line_doc, minlength=block.n_docs) - np.bincount(line_doc[distinct], minlength=block.n_docs)

    most = longest_repeats(block.hashes(starts, ends), doc, block.n_docs)
    inside = covered(most, window)
    repeat_words = np.bincount(doc[inside], minlength=block.n_docs)
    covered_chars = np.bincount(doc[inside], width[inside], block.n_docs).astype(np.int64)
    word_chars = np.bincount(doc, width, block.n_docs).astype(np.int64)
    longest = np.zeros(block.n_docs, np.int64)
    np.maximum.at(longest, doc, most)
    same_doc = np.r_[False, doc[1:] == doc[:-1]]
    maximal = (most >= window) & ~(same_doc & (np.r_[0, most[:-1]] == most + 1))
    n_maximal = np.bincount(doc[maximal], minlength=block.n_docs)

    spans: list[list] = [[] for _ in texts]
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    for a, b in zip(first, last, strict=True):
        while doc[a] != doc[b]:  # runs of two texts may touch
            stop = int(np.searchsorted(doc, doc[a], "right")) - 1
            spans[doc[a]].append([int(chars[starts[a]] - chars[block.offsets[doc[a]]]), int(chars[ends[stop]] - chars[block.offsets[doc[a]]])])
            a = stop + 1
        spans[doc[a]].append([int(chars[starts[a]] - chars[block.offsets[doc[a]]]), int(chars[ends[b]] - chars[block.offsets[doc[a]]])])

    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_WINDOW_SHARE * n_words)
    good = (covered_chars <= max_covered * word_chars) & (longest <= max_longest)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "base_failed": failed, "kept": ~failed & good, "longest_repeat": longest, "covered_chars": covered_chars, "n_maximal": n_maximal, "repeat_spans": spans,
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document with its counts, repeated spans (in characters) and verdict; no shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), texts_of(part.column(1))
            for a, b in groups(texts):
                out = rate(texts[a:b], max_covered, max_longest)
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "repeat_spans": pa.list_(pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b]} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
