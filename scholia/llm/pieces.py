"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding starts from characters and merges the best-ranked neighbouring pair until none is left.
Each candidate merge (this pair at this place of this unit) is skipped for good if a hash keyed
by the seed says so, with probability `dropout`; pairs that later merges create get decisions of
their own.  Any segmentation decodes to the original bytes: spaces become the space mark, a
literal space mark and all characters without a piece become byte pieces, and nothing is
normalised or stripped.

A text is cut into units between two bytes that no piece of the model has next to each other (so
nothing ever merges across): before spaces, around line breaks and mostly around punctuation.  A unit's key is drawn by hash from seed, document and place, so each occurrence of a
word has decisions of its own.  What a unit merges to without a skip, and all candidates that come
up on the way, are kept by its bytes: an occurrence none of whose candidates is skipped takes the
kept result, which is the one it would come to.  The others are merged in step with numpy, one
merge in each unit a step; a unit of more than LONG characters goes through a heap agenda with the
same decisions.

Defined results: null or empty texts have no ids and decode to the empty text; a null doc_id
counts as 0 in the draw; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import U64, Block, gathered, groups, mix, texts_of
from .units import Store, kept_in_worker, ranges, spans_array

SPACE_MARK = "▁"
LONG = 64
DROPOUT = 0.1
GROUP = 1 << 21
NONE = np.iinfo(np.int32).max

SCHEMA = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, lossless boolean, ids array<int>"


class Vocabulary:
    """Tables made from a SentencePiece BPE model with byte fallback."""

    def __init__(self, proto: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = m.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        spelled, normal = [b""] * n, {}
        for k in range(n):
            piece = m.id_to_piece(k)
            if m.is_byte(k):
                self.byte_id[int(piece[1:-1], 16)] = k
                spelled[k] = bytes([int(piece[1:-1], 16)])
            elif not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)):
                normal[piece] = k
                spelled[k] = piece.replace(SPACE_MARK, " ").encode()
        order = sorted(normal, key=lambda p: (-m.get_score(normal[p]), normal[p]))
        rank = {p: r for r, p in enumerate(order)}
        pairs = [(normal[p[:c]], normal[p[c:]], rank[p], normal[p]) for p in normal for c in range(1, len(p)) if p[:c] in normal and p[c:] in normal]
        left, right, best, merged = np.array(pairs, np.int64).reshape(-1, 4).T
        bits = max(int(len(pairs) * 4).bit_length(), 4)
        self.mask = (1 << bits) - 1
        self.slot_key, self.slot_rank, self.slot_id = np.full(1 << bits, -1), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        todo, key = np.arange(len(pairs)), (left << 20) | right
        slot = self._home(key)
        while len(todo):
            free = todo[self.slot_key[slot[todo]] < 0]
            at, who = np.unique(slot[free], return_index=True)
            who = free[who]
            self.slot_key[at], self.slot_rank[at], self.slot_id[at] = key[who], best[who], merged[who]
            todo = np.setdiff1d(todo, who)
            slot[todo] = (slot[todo] + (self.slot_key[slot[todo]] >= 0)) & self.mask
        self.inside = np.zeros((256, 256), bool)  # pairs of bytes that stand next to each other in some piece
        for k in normal.values():
            raw = np.frombuffer(spelled[k], np.uint8)
            self.inside[raw[:-1], raw[1:]] = True
        self.inside[:, 0x80:0xC0] = True  # no cut inside a character
        single = {p: k for p, k in normal.items() if len(p) == 1 and p != SPACE_MARK}
        self.ascii = np.full(128, -1, np.int64)
        for p, k in single.items():
            if ord(p) < 128:
                self.ascii[ord(p)] = k
        self.ascii[32] = normal.get(SPACE_MARK, -1)
        wide = sorted((int.from_bytes(p.encode(), "big"), k) for p, k in single.items() if ord(p) >= 128)
        self.wide_key, self.wide_id = np.array([x for x, _ in wide], np.int64), np.array([k for _, k in wide], np.int64)
        self.size = np.array([len(x) for x in spelled])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & U64(self.mask)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a pair that merges to nothing gets a slot of rank NONE."""
        key = np.where((left < 0) | (right < 0), -2, (left.astype(np.int64) << 20) | right)
        slot = self._home(key)
        active = np.flatnonzero((self.slot_key[slot] != key) & (self.slot_key[slot] >= 0))
        while len(active):
            slot[active] = (slot[active] + 1) & self.mask
            active = active[(self.slot_key[slot[active]] != key[active]) & (self.slot_key[slot[active]] >= 0)]
        return slot

    def characters(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters of UTF-8 bytes (-1: no piece), and their first bytes."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(np.r_[at, len(data)])
        ids = np.full(len(at), -1, np.int64)
        plain = data[at] < 128
        ids[plain] = self.ascii[data[at[plain]]]
        wide = np.flatnonzero(~plain)
        if len(wide) and len(self.wide_key):
            key = np.zeros(len(wide), np.int64)
            for k in range(4):
                more = size[wide] > k
                key[more] = (key[more] << 8) | data[at[wide[more]] + k]
            place = np.minimum(np.searchsorted(self.wide_key, key), len(self.wide_key) - 1)
            ids[wide] = np.where(self.wide_key[place] == key, self.wide_id[place], -1)
        return ids, at

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.start[ids], self.size[ids])].tobytes()


def _codes(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each candidate: this pair at this place of the unit."""
    return place.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + ((left.astype(np.uint64) << U64(20)) | right.astype(np.uint64)) * U64(0xD6E8FEB86659FD93)


def _skipped(key: np.ndarray, code: np.ndarray, limit: int) -> np.ndarray:
    return (mix(key + code) >> U64(32)) < U64(limit)


def _ranks(v: Vocabulary, unit, key, place, left, right, limit, seen):
    """Ranks of the pairs, NONE for those that are no candidates or are skipped; `seen` collects all candidates."""
    slot = v.look(left, right)
    rank = v.slot_rank[slot].copy()
    if limit or seen is not None:
        some = np.flatnonzero(rank != NONE)
        code = _codes(place[some], left[some], right[some])
        if seen is not None:
            seen.append((unit[some], code))
        if limit:
            rank[some[_skipped(key[some], code, limit)]] = NONE
    return rank


def merge_units(v: Vocabulary, ids: np.ndarray, unit: np.ndarray, place: np.ndarray, keys: np.ndarray, limit: int, seen: list | None = None):
    """Merge the symbols of all units in step; returns the remaining symbols' ids, units and places."""
    done: list[tuple] = []
    ids, unit, place = (x.astype(np.int32) for x in (ids, unit, place))
    rank = np.full(len(ids), NONE, np.int32)
    same = np.flatnonzero(unit[:-1] == unit[1:])
    rank[same] = _ranks(v, unit[same], keys[unit[same]], place[same], ids[same], ids[same + 1], limit, seen)
    while len(ids):
        heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(ids)]))
        over = np.flatnonzero(least == NONE)
        keep = np.ones(len(ids), bool)
        if len(over):
            done.append((ids[over], unit[over], place[over]))
            keep[over] = False
        hit = np.flatnonzero((rank == least) & keep)
        hit = hit[np.r_[True, unit[hit[1:]] != unit[hit[:-1]]]] if len(hit) else hit  # the leftmost of each unit
        ids[hit] = v.slot_id[v.look(ids[hit], ids[hit + 1])]
        keep[hit + 1] = False
        stay = np.flatnonzero(keep)
        hit = np.searchsorted(stay, hit)
        ids, unit, place, rank = ids[stay], unit[stay], place[stay], rank[stay]
        rank[hit] = NONE
        pair = np.r_[hit, hit - 1]
        pair = pair[(pair >= 0) & (pair + 1 < len(ids))]
        pair = pair[unit[pair] == unit[pair + 1]]
        rank[pair] = _ranks(v, unit[pair], keys[unit[pair]], place[pair], ids[pair], ids[pair + 1], limit, seen)
    if not done:
        return ids, unit, place
    ids, unit, place = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(unit, kind="stable")
    return ids[order], unit[order], place[order]


def merge_long(v: Vocabulary, ids: np.ndarray, place: np.ndarray, unit: int, key: np.uint64, limit: int, seen: list | None = None):
    """One long unit through an agenda; the same merges as merge_units."""
    n = len(ids)
    ids, before, after, alive = ids.tolist(), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    agenda: list[tuple] = []

    def add(many):
        if many:
            left, right = (np.array([ids[x] for x in side]) for side in zip(*many, strict=True))
            rank = _ranks(v, np.full(len(many), unit), np.full(len(many), key), place[[a for a, _ in many]], left, right, limit, seen)
            for (a, b), r in zip(many, rank.tolist(), strict=True):
                if r != NONE:
                    heapq.heappush(agenda, (r, a, b, ids[a], ids[b]))

    add([(k, k + 1) for k in range(n - 1)])
    while agenda:
        _, a, b, x, y = heapq.heappop(agenda)
        if not (alive[a] and alive[b] and ids[a] == x and ids[b] == y and after[a] == b):
            continue
        ids[a] = int(v.slot_id[v.look(np.array([x]), np.array([y]))[0]])
        alive[b] = False
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        add([p for p in ((before[a], a), (a, after[a])) if min(p) >= 0])
    left = [k for k in range(n) if alive[k]]
    return np.array([ids[k] for k in left], np.int64), place[left]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, seed: int = 0, dropout: float = DROPOUT):
        self.v, self.seed, self.limit = vocabulary, seed, int(dropout * (1 << 32))
        self.store = Store((np.int32, np.uint64))  # ids without a skip, candidates

    def keys(self, doc_ids: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The keys of occurrences, from the seed, the document's id and the unit's number in the text."""
        own = mix(doc_ids.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + mix(np.array([self.seed], np.uint64) + U64(0xA24BAED4963EE407)))
        return mix(own + number.astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def encode(self, texts: list[bytes], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        self.store.trim()
        block = Block(texts)
        edges = np.r_[True, ~self.v.inside[block.buf[:-1], block.buf[1:]], True]
        edges[block.offsets] = edges[block.offsets[1:] - 1] = True
        edges = np.flatnonzero(edges)
        slots = self.store.slots(spans_array(block.buf, edges), self._without_skips)
        starts, ends = edges[:-1], edges[1:]
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, block.offsets[1:] - 1)] = False  # the line break after each text
        slots, starts, ends = slots[real], starts[real], ends[real]
        doc = block.doc_of(starts)
        if not self.limit:
            ids, sizes = self.store.spell(slots)
            return ids, np.bincount(doc, sizes, block.n_docs).astype(np.int64)
        keys = self.keys(doc_ids[doc], np.arange(len(starts)) - np.searchsorted(doc, doc))
        code, count = self.store.spell(slots, 1)
        which = np.repeat(np.arange(len(slots)), count)
        again = np.zeros(len(slots), bool)
        again[which[_skipped(keys[which], code, self.limit)]] = True
        kept, k = np.flatnonzero(~again), np.flatnonzero(again)
        sizes = np.empty(len(slots), np.int64)
        own, sizes[kept] = self.store.spell(slots[kept])
        more, sizes[k] = self._merge(block.buf[ranges(starts[k], ends[k] - starts[k])], ends[k] - starts[k], keys[k], self.limit)
        first = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        ids[ranges(first[kept], sizes[kept])] = own
        ids[ranges(first[k], sizes[k])] = more
        return ids, np.bincount(doc, sizes, block.n_docs).astype(np.int64)

    def _without_skips(self, units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        seen: list[tuple] = []
        size = np.fromiter(map(len, units), np.int64, len(units))
        ids, count = self._merge(np.frombuffer(b"".join(units), np.uint8), size, np.zeros(len(units), np.uint64), 0, seen)
        unit, code = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return [(ids, count), (code[np.argsort(unit, kind="stable")], np.bincount(unit, minlength=len(units)))]

    def _merge(self, data: np.ndarray, width: np.ndarray, keys: np.ndarray, limit: int, seen: list | None = None):
        """Merge units that stand one after another in data: their ids, and the number for each."""
        v = self.v
        first = np.cumsum(width) - width
        ids, at = v.characters(data)
        unit = np.searchsorted(first + width, at, "right")
        place = at - first[unit] if len(at) else at
        count = np.bincount(unit, minlength=len(width))
        long = count > LONG
        short = ~long[unit]
        out = [merge_units(v, ids[short], unit[short], place[short], keys, limit, seen)]
        for u in np.flatnonzero(long):
            a = np.searchsorted(unit, u)
            got, where = merge_long(v, ids[a : a + count[u]], place[a : a + count[u]], u, keys[u], limit, seen)
            out.append((got, np.full(len(got), u), where))
        ids, unit, place = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        if long.any():
            order = np.argsort(unit, kind="stable")
            ids, unit, place = ids[order], unit[order], place[order]
        # a symbol without a piece is spelled as its bytes
        begin = first[unit] + place
        stop = np.r_[begin[1:], len(data)]
        size = np.where(ids < 0, stop - begin, 1)
        spread = np.repeat(ids, size)
        spread = np.where(spread < 0, v.byte_id[data[ranges(begin, size)]], spread)
        return spread.astype(np.int32), np.bincount(unit, size, len(width)).astype(np.int64)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = DROPOUT, with_ids: bool = True) -> DataFrame:
    """Per document: its ids, their number and checksum, and whether they decode to the text. No shuffle."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the model file, whatever the input

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("pieces", shared.value, seed, dropout), lambda: Encoder(Vocabulary(shared.value), seed, dropout))
        for part in gathered(parts, GROUP):
            names, texts = part.column(0), texts_of(part.column(1))
            for a, b in groups(texts, GROUP):
                numbers = np.array([0 if x is None else x for x in names[a:b].to_pylist()], np.int64)
                ids, count = encoder.encode(texts[a:b], numbers)
                at = np.r_[0, np.cumsum(count)]
                little = np.ascontiguousarray(ids, "<u4")
                own = [little[x:y] for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": names[a:b], "n_bytes": pa.array([len(t) for t in texts[a:b]], pa.int64()), "n_tokens": pa.array(count),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()), "lossless": pa.array([encoder.v.decode(x.astype(np.int64)) == t for x, t in zip(own, texts[a:b], strict=True)]),
                    "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())) if with_ids else pa.nulls(b - a, pa.list_(pa.int32())),
                })

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from ids; null ids give the empty text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for part in parts:
            texts = [v.decode(np.array(x or [], np.int64)).decode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
