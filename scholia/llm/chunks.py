"""Substring dedup by seeds that are extended to the true edges of each match.

A gear rolling hash over the last 32 bytes places cuts, so the same passage is mostly cut alike
wherever it stands, and an insertion moves only the cuts beside it.  Seeds are these chunks, and
the windows of 32 bytes that have the least hash of all that end in some stretch of `min_run`
bytes: two texts that share so long a passage share such a window, wherever it stands in them.
Of all documents that hold a seed the one with the least id owns it.  Each seed is compared with
the owner's text byte by byte and extended in both directions; later places of the same text are
extended against the place before.  Stretches of adjacent matches of at least `min_run` bytes are
removed, so a passing phrase never is.

Shuffles carry 8-byte digests, and of the owners' texts the surroundings of owned seeds: pieces of
CELL bytes with MARGIN more on either side.  The few matches that reach the end of a piece
elsewhere than at the end of a text are done again with the whole text of the owner.  Joins meet
plain exchanges that Spark can split where a digest or a piece is hot.

Defined results: null text counts as empty and stays null if nothing is removed; rows that share
an id count as one document, and null ids come before all others (equal texts with null ids
share one); a match never splits a character; extra columns are ignored.  A seed is compared with
one owner only, so a passage each of whose seeds also stands in some earlier document is removed
as far as it matches these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, Block, cut, groups, lean, mix, row_key, texts_of

MIN_CHUNK = 32  # not less than the 32 bytes that the rolling hash sees
MASK_BITS = 4
MAX_CHUNK = 192
MIN_RUN = 128
WINDOW = 32  # what the rolling hash sees
CELL, MARGIN = 1024, 512
#: Texts are chunked in groups of about this many bytes.
GROUP = 1 << 19

GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte, the sum of GEAR of it and the 31 before, each shifted left by its distance."""
    h = GEAR[buf]
    step = 1
    while step < 32:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h


def chunk(block: Block, min_chunk: int = MIN_CHUNK, bits: int = MASK_BITS, max_chunk: int = MAX_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the chunks, in order; no chunk splits a character."""
    buf = block.buf
    whole = np.r_[(buf[1:] & 0xC0) != 0x80, True]  # a cut after this byte is between characters
    cuts = np.flatnonzero((gear(buf) >> np.uint32(32 - bits) == 0) & whole) + 1
    cuts = np.r_[cuts, len(buf) + max_chunk]
    at, stop, doc = block.offsets[:-1].copy(), block.offsets[1:] - 1, np.arange(block.n_docs)
    live = at < stop
    at, stop, doc = at[live], stop[live], doc[live]
    found = []
    while len(at):  # one chunk of every text a round
        end = np.minimum(cuts[np.searchsorted(cuts, at + min_chunk)], at + max_chunk)
        end = np.minimum(end, stop)
        inside = end < stop
        for _ in range(3):
            end[inside] += (buf[end[inside]] & 0xC0) == 0x80
        found.append((at, end, doc))
        live = end < stop
        at, stop, doc = end[live], stop[live], doc[live]
    if not found:
        return (np.empty(0, np.int64),) * 3
    starts, ends, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts)
    return starts[order], ends[order], doc[order]


def least_windows(block: Block, min_run: int = MIN_RUN) -> np.ndarray:
    """Starts of the windows that have the least hash of some min_run bytes of a text, the leftmost of equals."""
    n = len(block.buf)
    if n < WINDOW:
        return np.empty(0, np.int64)
    value = (gear(block.buf)[WINDOW - 1 :].astype(np.uint64) * U64(0x9E3779B1) & U64(0xFFFFFFFF)) << U64(32) | np.arange(n - WINDOW + 1, dtype=np.uint64)
    stop = block.offsets[1:] - 1
    whole = np.ones(n + 1, bool)
    for k in range(WINDOW):  # windows with a text's border inside
        whole[np.maximum(stop - k, 0)] = False
    value[~whole[: len(value)]] |= U64(0xFFFFFFFF << 32)
    width, have = max(min_run - WINDOW + 1, 1), 1
    while have < width and len(value):
        step = min(have, width - have)
        value, have = np.minimum(value[:-step], value[step:]), have + step
    at = (value & U64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return at[whole[at]]


def _seeds(texts: list[bytes], min_run: int):
    """Per seed: digest, text, place in the text and size; and the block with its chunks."""
    block = Block(texts)
    starts, ends, doc = chunk(block)
    at = least_windows(block, min_run)
    first, last = np.r_[starts, at], np.r_[ends, at + WINDOW]
    owner = np.r_[doc, block.doc_of(at)]
    return block.hashes(first, last), owner, first - block.offsets[owner], last - first, block, starts, ends, doc


def _seed_rows(min_run: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, texts = part.column(0).to_numpy(), texts_of(part.column(1))
            for x, y in groups(texts, GROUP):
                digest, doc, at, size, *_ = _seeds(texts[x:y], min_run)
                yield pa.RecordBatch.from_pydict({"digest": pa.array(digest.view(np.int64)), "key": pa.array(keys[x:y][doc]), "at": pa.array(at.astype(np.int32)), "size": pa.array(size.astype(np.int16))})

    return run


def _after(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes from a[i] and b[j] on are equal."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n < most:
        x, y = a[i + n : i + min(n + 512, most)], b[j + n : j + min(n + 512, most)]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return n + len(x) - (differ.bit_length() + 7) // 8
        n += len(x)
    return n


def _before(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes before a[i] and b[j] are equal."""
    n, most = 0, min(i, j)
    while n < most:
        step = min(512, most - n)
        x, y = a[i - n - step : i - n], b[j - n - step : j - n]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + step - (differ.bit_length() + 7) // 8
        n += step
    return n


def matches(text: bytes, piece: bytes, base: int, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(shift, start, end) of the extended matches of text with a piece that starts at `base` of its own text; seeds: (place in text, size, place in the other text)."""
    found, reached = [], {}
    for at, size, other in sorted(seeds):
        shift = at - other
        if at + size <= reached.get(shift, -1):
            continue
        i = other - base
        if i < 0 or len(text) < at + size or piece[i : i + size] != text[at : at + size]:
            continue
        end = at + size + _after(text, at + size, piece, i + size)
        found.append((shift, at - _before(text, at, piece, i), end))
        reached[shift] = end
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def foreign_spans(text: bytes, pieces: list[dict]) -> tuple[list[tuple[int, int]], list[dict]]:
    """Merged matches with the pieces of other texts, and the pieces that end too early for a match."""
    lines: dict[tuple[int, int], list] = {}
    for p in pieces:
        stop = p["base"] + len(p["piece"])
        for shift, a, b in matches(text, p["piece"], p["base"], [(s["at"], s["size"], s["start"]) for s in p["seeds"]]):
            lines.setdefault((p["owner"], shift), []).append((a, b, a > 0 and p["base"] > 0 and a - shift == p["base"], b < len(text) and not p["last"] and b - shift == stop, p))
    spans = merged([(a, b) for line in lines.values() for a, b, *_ in line])
    early = []
    for line in lines.values():
        covered = merged([(a, b) for a, b, *_ in line])  # of one owner at one shift: what goes on in the next piece is here too
        for a, b, left, right, p in line:
            left = left and any(x == a for x, _ in covered) and not (spans[0][0] == 0 and a <= spans[0][1])
            right = right and any(y == b for _, y in covered) and not (spans[-1][1] == len(text) and b >= spans[-1][0])
            if left or right:
                early.append(p)
    return spans, early


def remove_copies(texts: list[bytes], foreign: list, min_run: int = MIN_RUN) -> dict[str, list]:
    """foreign: for each text the starts and ends, in turn, of the stretches that other documents own."""
    digest, owner, at, size, block, starts, ends, doc = _seeds(texts, min_run)
    order = np.lexsort((at, size, digest, owner))
    same = np.flatnonzero((digest[order][1:] == digest[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (size[order][1:] == size[order][:-1]) & (at[order][1:] != at[order][:-1])) + 1
    later: dict[int, list] = {}
    for d, a, n, b in zip(owner[order[same]].tolist(), at[order[same]].tolist(), size[order[same]].tolist(), at[order[same - 1]].tolist(), strict=True):
        later.setdefault(d, []).append((a, n, b))
    count = np.bincount(doc, minlength=block.n_docs)
    begin = np.searchsorted(doc, np.arange(block.n_docs))
    out: dict[str, list] = {k: [] for k in ("kept", "n_bytes", "n_chunks", "n_copied", "n_removed", "n_runs")}
    for d, t in enumerate(texts):
        flat = list(foreign[d]) if foreign[d] is not None else []
        spans = list(zip(flat[0::2], flat[1::2], strict=True)) + [(a, b) for _, a, b in matches(t, t, 0, later.get(d, []))]
        whole = []
        for a, b in merged(spans):
            while a < b and t[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(t) and t[b] & 0xC0 == 0x80:
                b -= 1
            whole.append((a, b))
        gone = [(a, b) for a, b in whole if b - a >= min_run]
        copied = 0
        if gone:
            s, e = (x[begin[d] : begin[d] + count[d]] - block.offsets[d] for x in (starts, ends))
            left, right = (np.array(x) for x in zip(*gone, strict=True))
            k = np.searchsorted(left, s, "right") - 1
            copied = int(((k >= 0) & (e <= right[np.maximum(k, 0)])).sum())
        edges = [0, *(x for span in gone for x in span), len(t)]
        out["kept"].append(b"".join(t[a:b] for a, b in list(pairwise(edges))[0::2]) if gone else t)
        for k, v in (("n_bytes", len(t)), ("n_chunks", int(count[d])), ("n_copied", copied), ("n_removed", sum(b - a for a, b in gone)), ("n_runs", len(gone))):
            out[k].append(v)
    return out


SCHEMA = "doc_id long, kept_text string, n_bytes long, n_chunks long, n_copied long, n_removed long, n_runs long"
PIECE = "owner long, cell int, base int, last boolean, piece binary"


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each owner's text the surroundings of the seeds in every cell that has some."""
    for part in parts:
        out: dict[str, list] = {"owner": [], "cell": [], "base": [], "last": [], "piece": []}
        for key, t, cells in zip(part.column(0).to_pylist(), texts_of(part.column(1)), part.column(2).to_pylist(), strict=True):
            for c in cells:
                base, stop = max(c * CELL - MARGIN, 0), (c + 1) * CELL + MAX_CHUNK + MARGIN
                for k, v in (("owner", key), ("cell", c), ("base", base), ("last", stop >= len(t)), ("piece", t[base:stop])):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict({"owner": pa.array(out["owner"], pa.int64()), "cell": pa.array(out["cell"], pa.int32()), "base": pa.array(out["base"], pa.int32()), "last": pa.array(out["last"], pa.bool_()), "piece": pa.array(out["piece"], pa.binary())})


def _spans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        spans, early = [], []
        for t, pieces in zip(texts_of(part.column(2)), part.column(3).to_pylist(), strict=True):
            found, again = foreign_spans(t, pieces)
            spans.append([x for span in found for x in span])
            early.append([{"owner": p["owner"], **s} for p in again for s in p["seeds"]])
        seed = pa.struct([("owner", pa.int64()), ("at", pa.int32()), ("size", pa.int16()), ("start", pa.int32())])
        yield pa.RecordBatch.from_pydict({"key": part.column(0), "row": part.column(1), "spans": pa.array(spans, pa.list_(pa.int32())), "early": pa.array(early, pa.list_(seed))})


def foreign_copies(own: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(key, row, foreign): for each (key, row, text), row a hash of text, the stretches that other documents own."""
    rows = own.select("key", "text").mapInArrow(lean(_seed_rows(min_run)), "digest long, key long, at int, size short")
    repeated = rows.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("o"), F.max("key").alias("other")).where("o.key <> other")
    repeated = cut(repeated.select("digest", F.col("o.key").alias("owner"), F.col("o.at").alias("start")), "repeated")
    cells = repeated.groupBy(F.col("owner").alias("key")).agg(F.collect_set(F.expr(f"cast(start div {CELL} as int)")).alias("cells"))
    pieces = cut(own.select("key", "text").join(cells, "key").select("key", "text", "cells").mapInArrow(lean(_pieces), PIECE), "pieces")
    copies = rows.join(repeated, "digest").where("key <> owner")
    seeds = F.collect_list(F.struct("at", "size", "start")).alias("seeds")
    copies = cut(copies.groupBy("key", "owner", F.expr(f"cast(start div {CELL} as int)").alias("cell")).agg(seeds), "copies")

    def spans(copies: DataFrame, pieces: DataFrame, on: list[str]) -> DataFrame:
        met = copies.join(pieces, on).groupBy("key").agg(F.collect_list(F.struct("owner", "base", "last", "piece", "seeds")).alias("pieces"))
        return cut(own.join(met, "key").select("key", "row", "text", "pieces").mapInArrow(lean(_spans), "key long, row long, spans array<int>, early array<struct<owner: long, at: int, size: short, start: int>>"), "spans")

    found = spans(copies, pieces, ["owner", "cell"])
    early = found.select("key", F.explode("early").alias("e")).select("key", "e.*").groupBy("key", "owner").agg(F.collect_set(F.struct("at", "size", "start")).alias("seeds"))
    early = cut(early, "early")
    if early.limit(1).count():
        texts = own.select(F.col("key").alias("owner"), F.lit(0).alias("base"), F.lit(True).alias("last"), F.col("text").cast("binary").alias("piece"))
        found = found.union(spans(early, texts, ["owner"]))
    return found.groupBy("key", "row").agg(F.flatten(F.collect_list("spans")).alias("foreign"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """docs with the copied stretches taken out of the text column; all columns stay as they are."""
    key, row, copied = "_scholia_key", "_scholia_row", "_scholia_copied"
    text = docs[text_col].cast("string")
    keyed = docs.withColumns({key: row_key(docs[id_col], text), row: F.xxhash64(text)})
    lists = foreign_copies(keyed.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), min_run)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, lists: pd.Series) -> pd.Series:
        raw, found = [b"" if t is None else t.encode() for t in texts], list(lists)
        out = [k for a, b in groups(raw, GROUP) for k in remove_copies(raw[a:b], found[a:b], min_run)["kept"]]
        return pd.Series([None if t is None else k.decode() for t, k in zip(texts, out, strict=True)], dtype="object")

    joined = keyed.join(lists.select(F.col("key").alias(key), F.col("row").alias(row), F.col("foreign").alias(copied)), [key, row], "left")
    return joined.withColumn(text_col, kept(F.col(text_col).cast("string"), F.coalesce(copied, F.array().cast("array<int>")))).select(*docs.columns)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """One row per document with its remaining text, and how many of its chunks lie in what was removed (n_copied)."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    own = own.select(row_key(own.doc_id, own.text).alias("key"), F.xxhash64("text").alias("row"), "doc_id", "text")
    lists = foreign_copies(own.select("key", "row", "text"), min_run)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts, copied = part.column(0), texts_of(part.column(1)), part.column(2).to_pylist()
            nulls = part.column(1).is_null().to_pylist()
            for x, y in groups(texts, GROUP):
                out = remove_copies(texts[x:y], copied[x:y], min_run)
                kept = [None if n and not k else k for n, k in zip(nulls[x:y], out.pop("kept"), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids[x:y], "kept_text": pa.array(kept, pa.binary()).cast(pa.string())} | {k: pa.array(v, pa.int64()) for k, v in out.items()})

    return own.join(lists, ["key", "row"], "left").select("doc_id", "text", "foreign").mapInArrow(lean(run), SCHEMA)
