"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if any string of `window` bytes that covers it starts at another place too.  Every
window belongs to one suffix bucket, the one of its minimiser: the GRAM-byte string inside it
that hashes least.  A run is a stretch of windows of one text with one minimiser.  Equal windows
have equal minimisers at equal offsets, so buckets that hold one run only are dropped after one
count, and no match is lost.

Runs of a bucket with the same bytes (told by 128 bits of hash, counted with map-side combination)
are repeated as a whole, and one of them stands for all: copies of any number cost one row.  The
different runs of a bucket are sorted bucket by bucket, in blocks of bounded size: suffixes of a
block are compared by their first 13 bytes and, if these agree, by ranks that were computed before
for the cover sample {0, 1, 3, 9} modulo 13 of the block's positions.  For any two positions some
offset below 13 takes both into the sample, so a tie of any length costs one look-up.  Sorted
neighbours that agree in `window` bytes are repeats.

A bucket of more than HOT different runs (a passage in ever new surroundings) is trimmed first:
windows whose 64-bit hash occurs once cannot repeat; the stretches between them are runs again,
of which those with the same bytes are collapsed as before, and the rest is sorted.  A hash that
agrees by chance only adds to the sort.

Defined results: null counts as empty; texts shorter than the window stay whole; repeated rows are
copies of each other; texts are told apart by 128 bits of hash; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, Block, cut, gathered, groups, mix, texts_of
from .units import ranges, spans_array

WINDOW = 200
GRAM = 32
BLOCK_BYTES = 1 << 20
#: What one bucket may hold in the sort (about 60 times as much memory), and so the runs, each of under 2 * WINDOW bytes, that it may have.
BUCKET_BYTES = 1 << 22
HOT = BUCKET_BYTES // (2 * WINDOW)
#: Texts whose minimisers are found at a time; the arrays of so many fit a core's cache.
RUN_BYTES = 1 << 18
COVER, PERIOD = (0, 1, 3, 9), 13
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: The least offset that takes positions of these two residues into the cover.
DELTA = np.array([[next(d for d in range(PERIOD) if IN_COVER[(a + d) % PERIOD] and IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def minimiser_runs(block: Block, window: int = WINDOW, gram: int = GRAM):
    """Maximal runs of window starts with one minimiser: first start, last start, minimiser, its hash, text."""
    n, span = len(block.buf), window - gram + 1
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    if n < window:
        return none
    h = block.rolling(gram)
    order = h & ~U64(0xFFFFFFFF)
    order |= np.arange(len(h), dtype=np.uint64)
    whole = np.full(-(-len(order) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(order)] = order
    tiles = whole.reshape(-1, span)
    ahead = np.minimum.accumulate(tiles, axis=1).reshape(-1)
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - window + 1], ahead[span - 1 : span + n - window])
    begin, stop = block.offsets[:-1], block.offsets[1:] - window
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    edge = edge[edge < stop[np.searchsorted(begin, edge, "right") - 1]]
    head = np.union1d(edge, begin[begin < stop])
    doc = np.searchsorted(begin, head, "right") - 1
    tail = np.minimum(np.r_[head[1:], n], stop[doc]) - 1
    least = (least[head] & U64(0xFFFFFFFF)).astype(np.int64)
    return head, tail, least, h[least], doc


#: What tells a text apart, and which of its copies stands for all.
TEXT = ["h1", "h2", "key"]
RUN = "anchor long, d1 long, d2 long, h1 long, h2 long, first int, last int, off int"


def _run_batch(block: Block, doc: np.ndarray, first: np.ndarray, last: np.ndarray, off: np.ndarray, anchor: np.ndarray, names: list[np.ndarray], window: int, begin: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of runs that start and end at these places of the block; `begin` is where their texts start, if the block holds parts of texts."""
    raw, digest = block.raw, xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)]), np.int64).reshape(-1, 2)
    begin = block.offsets[doc] if begin is None else begin
    return pa.RecordBatch.from_pydict({
        "anchor": pa.array(anchor.view(np.int64)), "d1": pa.array(d[:, 0]), "d2": pa.array(d[:, 1]), "h1": pa.array(names[0][doc]), "h2": pa.array(names[1][doc]),
        "first": pa.array((first - begin).astype(np.int32)), "last": pa.array((last - begin).astype(np.int32)), "off": pa.array(off.astype(np.int32)),
    })


def _run_rows(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(parts, RUN_BYTES):
            names, texts = [part.column(c).to_numpy() for c in (0, 1)], texts_of(part.column(2))
            for x, y in groups(texts, RUN_BYTES):
                block = Block(texts[x:y])
                first, last, least, anchor, doc = minimiser_runs(block, window)
                yield _run_batch(block, doc, first, last, least - first, anchor, [n[x:y] for n in names], window)

    return run


def _listed(runs: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Of a column of lists of structs: the row of each struct, and its fields."""
    lengths = np.diff(runs.offsets.to_numpy())
    flat = runs.flatten()
    return np.repeat(np.arange(len(runs)), lengths), *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _bucket_rows(window: int):
    """Of each text the runs that stand for their kind, with their bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(parts, RUN_BYTES):
            row, first, last, off, anchor, send = _listed(part.column("runs"), "first", "last", "off", "anchor", "send")
            row, first, last, off, anchor = (x[send] for x in (row, first, last, off, anchor))
            block = Block(texts_of(part.column("text")))
            size = (last - first + window).astype(np.int64)
            data = spans_array(block.buf[ranges(block.offsets[row] + first, size)], np.r_[0, np.cumsum(size)]).cast(pa.binary())
            names = {c: part.column(c).take(pa.array(row)) for c in TEXT}
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor)} | names | {"at": pa.array(first), "off": pa.array(off), "data": data})

    return run


def _hot_rows(window: int, anchors: np.ndarray):
    """Of each text the runs of these buckets (a sorted array), with their bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(parts, RUN_BYTES):
            names, texts = [part.column(c).to_numpy() for c in (0, 1)], texts_of(part.column(2))
            for x, y in groups(texts, RUN_BYTES):
                block = Block(texts[x:y])
                first, last, least, anchor, doc = minimiser_runs(block, window)
                hot = np.isin(anchor.view(np.int64), anchors)
                if not hot.any():
                    continue
                first, last, least, anchor, doc = (v[hot] for v in (first, last, least, anchor, doc))
                size = last - first + window
                data = spans_array(block.buf[ranges(first, size)], np.r_[0, np.cumsum(size)]).cast(pa.binary())
                yield _run_batch(block, doc, first, last, least - first, anchor, [n[x:y] for n in names], window).append_column("data", data)

    return run


def _window_rows(window: int):
    """Every window of the runs in hot buckets: its hash, its text and run, and its start."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(parts, RUN_BYTES):
            first, last, off, anchor = (part.column(c).to_numpy() for c in ("first", "last", "off", "anchor"))
            block = Block(texts_of(part.column("data")))
            size = (last - first + 1).astype(np.int64)
            which = np.repeat(np.arange(len(size)), size)
            inside = ranges(np.zeros(len(size), np.int64), size)
            at = block.offsets[which] + inside
            prefix, inverse = block._sums()
            w = mix((prefix[at + window] - prefix[at]) * inverse[at]) ^ mix(anchor.view(np.uint64).copy())[which]
            yield pa.RecordBatch.from_pydict({
                "w": pa.array(w.view(np.int64)), "anchor": pa.array(anchor[which]), "h1": part.column("h1").take(pa.array(which)), "h2": part.column("h2").take(pa.array(which)),
                "place": pa.array((first + off)[which].astype(np.int32)), "at": pa.array((first[which] + inside).astype(np.int32)),
            })

    return run


def _trimmed_rows(window: int):
    """Runs made of those starts of a run that are left."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(parts, RUN_BYTES):
            names = [part.column(c).to_numpy() for c in ("h1", "h2")]
            first, off, anchor = (part.column(c).to_numpy() for c in ("first", "off", "anchor"))
            block = Block(texts_of(part.column("data")))
            lists = part.column("starts")
            which, at = np.repeat(np.arange(len(first)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
            order = np.lexsort((at, which))
            at, which = at[order], which[order]
            edge = (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1])
            head, tail = np.flatnonzero(np.r_[True, edge]), np.flatnonzero(np.r_[edge, True])
            k = which[head]
            begin = block.offsets[k] - first[k]  # where the text of the run would start in the block
            yield _run_batch(block, k, begin + at[head], begin + at[tail], (first + off)[k] - at[head], anchor.view(np.uint64)[k], names, window, begin)

    return run


#: From each residue the distance to the cover.
NEXT = np.array([next(d for d in range(PERIOD) if IN_COVER[(a + d) % PERIOD]) for a in range(PERIOD)])


class CoverSort:
    """Suffix comparisons in one text: first bytes, then ranks of the cover sample."""

    def __init__(self, text: np.ndarray, window: int = WINDOW):
        n = len(text)
        key = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
        for k in (1, 2, 4):  # each pass doubles the bytes that a key holds
            key = key[:-k] << U64(8 * k) | key[k:]
        self.key, self.n, self.window = key, n, window
        at = np.flatnonzero(IN_COVER[np.arange(n) % PERIOD])
        order, new = self._by_first_bytes(key[at], key[np.minimum(at + 5, n)])
        self.levels: list[np.ndarray] = []
        rank = np.zeros(n + 1, np.int64)
        active = self._store(rank, new, at[order], np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
        self.levels.append(rank)
        step = PERIOD
        while len(active) and step < n:  # what is still tied then lies in the padding
            old = rank
            own = old[active]
            order = np.argsort((own.astype(np.uint64) << U64(32)) | old[np.minimum(active + step, n)].astype(np.uint64))
            active, own = active[order], own[order]
            nxt = old[np.minimum(active + step, n)]
            head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            new = np.r_[True, (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])]
            if step <= window:  # same() needs the ranks of lengths up to the window, less() the last ones
                rank = old.copy()
                self.levels.append(rank)
            active = self._store(rank, new, active, np.repeat(head, np.diff(np.r_[head, len(own)])), own)
            step *= 2
        self.top = rank

    @staticmethod
    def _by_first_bytes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by bytes 0 to 12 (a holds 0 to 7, b 5 to 12), and which of the ordered differ from the one before."""
        order = np.argsort(a)
        a, b = a[order], b[order]
        number = np.cumsum(np.r_[False, a[1:] != a[:-1]]).astype(np.uint64)
        if len(number) and number[-1] >> U64(24):
            inner = np.lexsort((b, number))
        else:
            inner = np.argsort(number << U64(40) | b & U64((1 << 40) - 1))
        a, b = a[inner], b[inner]
        return order[inner], np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]

    @staticmethod
    def _store(rank, new, moved, head, old):
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(moved)])
        rank[moved] = old + np.repeat(first, size) - head
        return moved[np.repeat(size, size) > 1]

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.key[i], self.key[j]
        out = a < b
        tie = np.flatnonzero(a == b)
        if len(tie):
            i, j = i[tie], j[tie]
            a, b = self.key[np.minimum(i + 5, self.n)], self.key[np.minimum(j + 5, self.n)]
            d = DELTA[i % PERIOD, j % PERIOD]
            top = self.top
            out[tie] = (a < b) | ((a == b) & (top[np.minimum(i + d, self.n)] < top[np.minimum(j + d, self.n)]))
        return out

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the first `window` bytes agree."""
        key, window = self.key, self.window
        ok = (key[i] == key[j]) & (key[i + 5] == key[j + 5])
        k = np.flatnonzero(ok)
        i, j = i[k], j[k]
        d = DELTA[i % PERIOD, j % PERIOD]
        good, done = np.ones(len(k), bool), d.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            size = PERIOD << level
            while (fits := done + size <= window).any():
                good &= ~fits | (self.levels[level][np.where(fits, i + done, self.n)] == self.levels[level][np.where(fits, j + done, self.n)])
                done = np.where(fits, done + size, done)
        for back in (8, 16):  # less than 13 bytes are left
            good &= key[i + window - back] == key[j + window - back]
        ok[k] = good
        return ok

    def sort(self, items: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Items in suffix order within each group; groups are contiguous and stay in place.

        Items of one residue have the same distance to the cover, so plain keys order them; the
        at most PERIOD lists of a group are then merged in pairs by comparisons.
        """
        residue = items % PERIOD
        rank = self.top[np.minimum(items + NEXT[residue], self.n)]
        order = np.lexsort((rank, self.key[np.minimum(items + 5, self.n)], self.key[items], residue, group))
        items, residue = items[order], residue[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (residue[1:] != residue[:-1])]
        while True:
            head = np.flatnonzero(new)
            size = np.diff(np.r_[head, len(items)])
            own = group[head]
            start = np.r_[True, own[1:] != own[:-1]]
            number = np.arange(len(head)) - np.maximum.accumulate(np.where(start, np.arange(len(head)), 0))
            left = number % 2 == 0
            paired = np.where(left, np.r_[~start[1:], False], True)
            if not paired.any():
                return items
            partner = np.where(paired, np.arange(len(head)) + np.where(left, 1, -1), 0)
            which = np.repeat(np.arange(len(head)), size)
            live = np.flatnonzero(paired[which])
            lists = which[live]
            low = head[partner[lists]]
            high = low + size[partner[lists]]
            first, mine, even = low.copy(), items[live], left[lists]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                met = items[mid]
                before = np.where(even[open_], self.less(met, mine[open_]), ~self.less(mine[open_], met))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            items = items.copy()
            items[np.where(even, head[lists], first) + (live - head[lists]) + (low - first)] = mine
            new[head[~left]] = False


def sort_block(anchors: np.ndarray, offs: np.ndarray, data: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of whole buckets: which of all their windows, run after run, occur at two places; and each window's run and place in it."""
    edges = data.offsets.to_numpy() if hasattr(data, "offsets") else np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    size = np.diff(edges).astype(np.int64)
    text = np.r_[np.frombuffer(data.buffers()[2], np.uint8)[edges[0] : edges[-1]], np.zeros(2 * window, np.uint8)]
    first = np.cumsum(size) - size
    count = size - window + 1
    at = ranges(first, count)
    row = np.repeat(np.arange(len(size)), count)
    inside = at - first[row]
    bucket = np.cumsum(np.r_[False, anchors[1:] != anchors[:-1]])[row] * (window + 1) + offs[row] - inside
    order = np.argsort(bucket, kind="stable")
    group = bucket[order]
    several = np.r_[False, group[1:] == group[:-1]]
    several = several | np.r_[several[1:], False]
    order, group = order[several], group[several]
    twice = np.zeros(len(at), bool)
    if len(order):
        sorter = CoverSort(text, window)
        items = sorter.sort(at[order], group)
        near = np.flatnonzero(group[1:] == group[:-1])
        near = near[sorter.same(items[near], items[near + 1])]
        index = np.empty(len(text), np.int64)
        index[at] = np.arange(len(at))
        twice[index[items[near]]] = twice[index[items[near + 1]]] = True
    return twice, row, inside


def _sort_buckets(window: int):
    """Rows come in the order of their buckets; whole buckets of about BLOCK_BYTES are sorted at a time."""

    def sort(table: pa.Table) -> pa.RecordBatch:
        anchors, offs, starts = (table[c].to_numpy() for c in ("anchor", "off", "at"))
        twice, row, place = sort_block(anchors, offs.astype(np.int64), table["data"].combine_chunks(), window)
        new = np.r_[True, row[1:] != row[:-1]]
        edge = twice & np.r_[True, ~twice[:-1] | new[1:]]
        stop = twice & np.r_[~twice[1:] | new[1:], True]
        r = row[edge]
        names = {c: pa.array(table[c].to_numpy()[r]) for c in TEXT}
        return pa.RecordBatch.from_pydict(names | {"lo": pa.array((starts[r] + place[edge]).astype(np.int32)), "hi": pa.array((starts[r] + place[stop]).astype(np.int32))})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in parts:
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                anchors = table["anchor"].to_numpy()
                last = int(np.searchsorted(anchors, anchors[-1]))  # the last bucket may go on
                if last:
                    yield sort(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield sort(pa.Table.from_batches(held).combine_chunks())

    return run


def _spans(window: int):
    """Texts with their runs that are repeated as a whole, and ranges of window starts found by sorting."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            row, first, last, whole = _listed(part.column("runs"), "first", "last", "whole")
            row, first, last = row[whole], first[whole], last[whole]
            more, lo, hi = _listed(part.column("ranges"), "lo", "hi")
            a, b = np.searchsorted(row, np.arange(part.num_rows + 1)), np.searchsorted(more, np.arange(part.num_rows + 1))
            for k, text in enumerate(texts_of(part.column("text"))):
                own, found = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
                kept, spans = remove(text, np.r_[first[own], lo[found]], np.r_[last[own], hi[found]], window)
                for name, v in zip(out, (len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans), strict=True):
                    out[name].append(v)
            kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"h1": part.column("h1"), "h2": part.column("h2")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def remove(text: bytes, lo: np.ndarray, hi: np.ndarray, window: int = WINDOW) -> tuple[bytes, list[list[int]]]:
    """The text without the windows that start at lo..hi (many such ranges), and the removed runs."""
    if not len(lo):
        return text, []
    order = np.argsort(lo)
    lo, top = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + window)
    head = np.flatnonzero(np.r_[True, lo[1:] > top[:-1]])
    spans = [[int(a), int(b)] for a, b in zip(lo[head], top[np.r_[head[1:], len(lo)] - 1], strict=True)]
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), spans


def _merged(df: DataFrame) -> DataFrame:
    """For joins with what grows with the input: one plan at every size, and no broadcast."""
    return df.hint("merge")


def _marked(live: DataFrame, limit: int | None) -> DataFrame:
    """Runs that repeat as a whole, that go to the sort (one of each kind in a bucket of several kinds), or that are in a bucket of more than `limit` kinds."""
    kinds = cut(live.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2", "first")).alias("lead")), "kinds")
    kinds = cut(kinds.join(_merged(kinds.groupBy("anchor").agg(F.count("*").alias("m"))), "anchor"), "kinds")
    send = (F.col("m") > 1) & (F.col("lead") == F.struct("h1", "h2", "first"))
    hot = send & (F.col("m") > limit) if limit else F.lit(False)
    found = live.join(_merged(kinds), ["anchor", "d1", "d2"]).select("h1", "h2", "anchor", "first", "last", "off", (F.col("n") > 1).alias("whole"), (send & ~hot).alias("send"), hot.alias("hot"))
    return found.where("whole or send or hot")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed)."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.coalesce("doc_id", F.lit(0)).alias("key"))
    copies = cut(own.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("n")), "copies")
    rows = cut(own.select("h1", "h2", "text").mapInArrow(_run_rows(window), RUN), "runs")
    shared = cut(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared")
    marked = cut(_marked(cut(rows.join(_merged(shared), "anchor"), "live"), HOT), "marked")

    def listed(found: DataFrame, *fields: str) -> DataFrame:
        """One row of each text with its runs."""
        lists = found.groupBy("h1", "h2").agg(F.collect_set(F.struct(*fields)).alias("runs")).join(_merged(copies), ["h1", "h2"])
        return own.select(*TEXT, "text").join(_merged(lists), TEXT)

    anchors = np.array([r[0] for r in marked.where("hot").select("anchor").distinct().toLocalIterator()], np.int64)  # one for more than HOT runs
    if len(anchors):
        # the runs of these buckets are found once more where texts are read, so that only their own bytes are shuffled, one of each kind
        sent = own.select("h1", "h2", "text").mapInArrow(_hot_rows(window, np.sort(anchors)), f"{RUN}, data binary")
        hot = cut(sent.groupBy("anchor", "d1", "d2").agg(F.min(F.struct("h1", "h2", "first", "last", "off", "data")).alias("lead")).select("anchor", "lead.*"), "hot")
        windows = cut(hot.mapInArrow(_window_rows(window), "w long, anchor long, h1 long, h2 long, place int, at int"), "windows")
        twice = cut(windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w"), "twice")
        left = cut(windows.join(_merged(twice), "w").groupBy("h1", "h2", "anchor", "place").agg(F.collect_list("at").alias("starts")), "left")
        trimmed = hot.withColumn("place", F.col("first") + F.col("off")).join(_merged(left), ["h1", "h2", "anchor", "place"]).mapInArrow(_trimmed_rows(window), RUN)
        marked = marked.where("whole or send").union(_marked(cut(trimmed, "trimmed"), None))
    needed = F.when(F.col("n") > 1, F.filter("runs", lambda x: x.send)).otherwise(F.col("runs"))  # a text that occurs twice goes as a whole
    texts = listed(marked, "first", "last", "off", "anchor", "whole", "send").select(*TEXT, "text", needed.alias("runs")).where("size(runs) > 0")

    # the texts are used twice in one plan, so they are shuffled once: spans come back to them by the same key
    buckets = texts.mapInArrow(_bucket_rows(window), "anchor long, h1 long, h2 long, key long, at int, off int, data binary")
    found = buckets.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_buckets(window), "h1 long, h2 long, key long, lo int, hi int")
    spans = found.groupBy(*TEXT).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    none = F.array().cast("array<struct<lo: int, hi: int>>")
    results = texts.join(_merged(spans), TEXT, "left").select("h1", "h2", "text", "runs", F.coalesce("ranges", none).alias("ranges"))
    results = cut(results.mapInArrow(_spans(window), "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"), "results").dropDuplicates(["h1", "h2"])
    info = cut(copies.select("h1", "h2", "n").join(_merged(results), ["h1", "h2"], "left"), "info")
    all_rows = own.select("doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    gone = (F.col("n") > 1) & (F.col("n_bytes") >= window)
    return all_rows.join(_merged(info), ["h1", "h2"]).select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(gone, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.col("spans")).alias("spans"),
    )
