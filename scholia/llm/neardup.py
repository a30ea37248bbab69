"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text is the weighted set of its five-word shingles, each weighing as often as it occurs.  Darts
are thrown by hash into the region of each element (its weight wide, without end in rank): in each
dyadic weight band they form a Poisson process along the rank, so a text only draws the darts
below a rank at which, given its total weight, every coordinate is expected to be hit.  A dart
lands in one of BANDS * ROWS coordinates; the earliest of each coordinate is the signature.  Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity (the sum of
the lesser weights over the sum of the greater ones).

Texts with equal weighted sets are collapsed first.  Equal bands put the rest into buckets; in
each bucket members are first compared with leaders, and the exact similarity of the two texts
decides.  The first leader is the least number; each of LEADER_ROUNDS rounds takes LEADERS members
that were no leaders yet, in an order drawn by hash, and compares with them all members that are
not in their class, so small buckets are compared in full.  These rounds only save work: where
the members that have not been leaders are still of two classes, every pair of these that can
reach the similarity is compared, found by exact prefix filtering (shingles in order of rarity,
bounds on sizes and positions).  Classes are the connected
components of all links found.

Defined results: a document is a pair of id and text, so rows with one id and different texts are
different documents, and equal rows are one (n_rows of them); texts without words are each a class
of their own; a text of one to four words has one shingle, all its words; a class is named by its
least id that is not null, and the document with it is kept (of several the least text hash);
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import SPACED, U64, Block, cut, groups, lean, mix, texts_of, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
LEADERS = 4  # of a bucket in a round
LEADER_ROUNDS = 1  # before the rest is compared, pair by pair


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes, texts and counts, ordered by text."""
    block = Block(texts, lower=True)
    starts, ends, doc = block.spans(SPACED)
    h = block.hashes(starts, ends)
    found, first = windows(h, doc, size)
    owner = doc[first]
    count = np.bincount(doc, minlength=block.n_docs)
    begin = np.searchsorted(doc, np.arange(block.n_docs))
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        alone = np.array([hash_of(h[begin[d] : begin[d] + count[d]]) for d in few], np.uint64)
        found, owner = np.concatenate([found, alone]), np.concatenate([owner, few])
    own = found ^ mix(owner.astype(np.uint64) + U64(0xC1A55))
    order = np.argsort(own)
    head = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(order) else order
    times = np.diff(np.r_[head, len(order)])
    pick = order[head]
    back = np.argsort(owner[pick], kind="stable")
    return found[pick][back], owner[pick][back], times[back]


def occurrences(element: np.ndarray, owner: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle as often as it occurs, told apart by number: plain Jaccard of these is the weighted one."""
    number = (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    again = np.repeat(element, times)
    more = np.flatnonzero(number)
    again[more] = mix(again[more] + number[more] * U64(0x9FB21C651E98DF25))
    return again, np.repeat(owner, times)


def hash_of(h: np.ndarray) -> int:
    total = 0x5107 + len(h)
    for x in h.tolist():
        total = (total * 0xD6E8FEB86659FD93 + x) % (1 << 64)
    return total


def dart_signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, t: int = BANDS * ROWS) -> np.ndarray:
    """n signatures of t darts (uint64: rank above, name below); all ones where a set is empty."""
    total = np.bincount(owner, weight, n)
    sig = np.full((n, t), np.iinfo(np.uint64).max, np.uint64)
    todo = total > 0
    limit = np.zeros(n)
    limit[todo] = (np.log(t) + 3) / total[todo]
    while todo.any():
        use = todo[owner]
        e, o, w = element[use], owner[use], weight[use]
        low, high, band = 0.0, 1.0, 0
        flat = sig.reshape(-1)
        while len(e):
            seed = mix(e + U64(0xA0761D6478BD642F * (band + 1) % (1 << 64)))
            rank, who, k = np.zeros(len(e)), np.arange(len(e)), 0
            while len(who):
                draw = mix(seed[who] + U64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
                rank = rank - np.log(((draw >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / (t * (high - low))
                near = rank < limit[o[who]]
                who, rank, draw = who[near], rank[near], draw[near]
                name = mix(draw ^ U64(0xE7037ED1A0B428DB))
                inside = low + (name >> U64(40)).astype(np.float64) * 2.0**-24 * (high - low) < w[who]
                key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << U64(32)) | (mix(name.copy()) & U64(0xFFFFFFFF))
                place = o[who] * t + (name & U64(0xFFFFFF)).astype(np.int64) % t
                np.minimum.at(flat, place[inside], key[inside])
                k += 1
            low, high, band = high, 2 * high, band + 1
            more = w > low
            e, o, w = e[more], o[more], w[more]
        todo &= (sig == np.iinfo(np.uint64).max).any(axis=1)
        limit[todo] *= 2
    return sig


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        h = mix((h ^ sig[:, r::rows][:, :bands]) * U64(0x9FB21C651E98DF25) + U64(r + 1))
    return mix(h + np.arange(bands, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def _sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = texts_of(part.column(3))
        for x, y in groups(texts):
            n = y - x
            element, owner, times = shingles(texts[x:y])
            bands = bands_of(dart_signatures(element, owner, times.astype(float), n)).view(np.int64)
            edge = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]
            sums = [np.r_[U64(0), np.cumsum(mix(element ^ U64(c)) * times.astype(np.uint64))] for c in (0x1234567, 0xFEDCBA987)]
            a, b = (s[edge[1:]] - s[edge[:-1]] for s in sums)
            size = np.bincount(owner, times, n).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                **{c: part.column(c)[x:y] for c in ("doc_id", "h1", "h2")}, "size": pa.array(size), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1))),
            })


def jaccard(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair; 0 for two empty sets."""
    element, owner = occurrences(*shingles([t for pair in zip(left, right, strict=True) for t in pair]))
    size = np.bincount(owner, minlength=2 * len(left))
    own = element ^ mix((owner // 2).astype(np.uint64) + U64(0xBA1))
    order = np.argsort(own)
    same = np.flatnonzero(own[order][1:] == own[order][:-1])  # one shingle in both texts of a pair
    both = np.bincount(owner[order[same]] // 2, minlength=len(left))
    union = size[0::2] + size[1::2] - both
    return both / np.maximum(union, 1)


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        left, right = texts_of(part.column(2)), texts_of(part.column(3))
        for x, y in groups([a + b for a, b in zip(left, right, strict=True)]):
            yield pa.RecordBatch.from_pydict({"u": part.column(0)[x:y], "v": part.column(1)[x:y], "similarity": pa.array(jaccard(left[x:y], right[x:y]))})


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (key, class) with all classes joined that links (u, v) connect; a joined class takes the least name.

    The graph is one of classes, not of keys.  Each step takes the least root among neighbours and
    then the root of that root; tables are written to the shared folder each time, so lineage
    stays short.  Joins meet plain scans.
    """
    name = lambda side, end: labels.select(F.col("key").alias(side), F.col("class").alias(end))
    pairs = links.select("u", "v").join(name("u", "a"), "u").join(name("v", "b"), "v").where("a <> b").select("a", "b").distinct()
    pairs = cut(pairs, "pairs")
    if not pairs.limit(1).count():
        return labels
    both = cut(pairs.union(pairs.select("b", "a")).distinct(), "both")
    roots = cut(both.select(F.col("a").alias("class")).distinct().select("class", F.col("class").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("class").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "class")
        step = cut(roots.join(near, "class").select("class", F.col("root").alias("old"), F.least("root", "near").alias("root")), "step")
        if not step.where("root <> old").limit(1).count():
            break
        up = step.select(F.col("class").alias("root"), F.col("root").alias("top"))
        roots = cut(step.select("class", "root").join(up, "root").select("class", F.least("root", "top").alias("root")), "roots")
    return cut(labels.join(roots, "class", "left").select("key", F.coalesce("root", "class").alias("class")), "labels")


IDENTITY = ["doc_id", "h1", "h2"]


def _identified(docs: DataFrame, id_col: str, text_col: str) -> list:
    text = docs[text_col].cast("string")
    return [docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _same(left: DataFrame, right: DataFrame):
    """Two tables hold the same document (null ids are equal)."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.h1 == right.h1) & (left.h2 == right.h2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, h1 and h2 (hashes of its text), class_id, kept, n_rows (equal rows) and n_copies (other documents with the same shingles)."""
    own = docs.select(*_identified(docs, id_col, text_col), docs[text_col].cast("string").alias("text"))
    signed = own.mapInArrow(lean(_sign), "doc_id long, h1 long, h2 long, size long, a long, b long, bands array<long>")
    signed = signed.groupBy(IDENTITY).agg(F.any_value(F.struct("size", "a", "b", "bands")).alias("s"), F.count("*").alias("n_rows"))
    signed = cut(signed.select(F.monotonically_increasing_id().alias("key"), *IDENTITY, "s.*", "n_rows"), "signed")  # numbered once, as they are written
    some = signed.where("size > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *IDENTITY)).alias("lead")
    sets = cut(some.groupBy("size", "a", "b").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), lead), "sets")
    rows = some.select("key", "bands").join(sets.select(F.col("rep").alias("key")), "key").select("key", F.explode("bands").alias("band"))
    rows = cut(rows.select("band", "key"), "rows")
    full = cut(rows.groupBy("band").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead <> last").select("band", "lead"), "full")
    shared = cut(rows.join(full, "band").select("band", "key", "lead"), "shared")
    wanted = cut(shared.select("key").distinct(), "wanted")
    named = cut(signed.select("key", *IDENTITY).join(wanted, "key"), "named")
    named = named.hint("merge")  # one plan at every size: nothing that grows with the input is broadcast
    texts = own.join(named, _same(own, named)).select("key", "text")
    texts = cut(texts.groupBy("key").agg(F.any_value("text").alias("text")), "texts")

    labels = wanted.select("key", F.col("key").alias("class"))
    pairs = shared.where("key <> lead").groupBy("key").agg(F.min("lead").alias("lead")).select(F.col("lead").alias("u"), F.col("key").alias("v"))
    pairs = cut(pairs, "pairs")
    tested, labels = pairs, components(_linked(pairs, texts, similarity), labels)
    never = F.lit((1 << 63) - 1)
    members = shared.select("band", "key", *(never.alias(f"last{k}") for k in range(LEADERS)))
    for _ in range(LEADER_ROUNDS):
        members, pairs = _next_pairs(members, labels, tested)
        if not pairs.limit(1).count():
            continue
        tested, labels = tested.union(pairs), components(_linked(pairs, texts, similarity), labels)
    rest = cut(_rest_pairs(members, labels, texts, similarity).join(tested, ["u", "v"], "left_anti"), "rest")
    if rest.limit(1).count():
        labels = components(_linked(rest, texts, similarity), labels)
    return _result(signed, sets, labels)


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    left = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("t")), "u")
    right = left.join(texts.select(F.col("key").alias("v"), F.col("text").alias("s")), "v")
    return cut(right.select("u", "v", "t", "s").mapInArrow(lean(_compare), "u long, v long, similarity double").where(F.col("similarity") >= similarity), "new")


def _shingle_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        keys, classes, texts = part.column(0).to_numpy(), part.column(1).to_numpy(), texts_of(part.column(2))
        for x, y in groups(texts):
            element, owner = occurrences(*shingles(texts[x:y]))
            size = np.bincount(owner, minlength=y - x)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(element.view(np.int64)), "key": pa.array(keys[x:y][owner]), "class": pa.array(classes[x:y][owner]), "size": pa.array(size[owner])})


def _rest_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs of different classes that can reach the similarity, among the members that were no leaders of buckets in which these are of two classes.

    With shingles in order of rarity, the first that two texts share stands early in both: what
    follows it must hold all that they share.
    """
    classes = members.where(_waiting()).select("band", "key").join(labels, "key")
    mixed = classes.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("band")
    members = cut(classes.join(mixed, "band").select("key", "class").distinct(), "unsettled")
    rows = cut(members.join(texts, "key").select("key", "class", "text").mapInArrow(lean(_shingle_rows), "shingle long, key long, class long, size long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = rows.join(often, "shingle")  # a shingle of one text comes before all others and joins nothing
    by_key = Window.partitionBy("key")
    place = F.col("size") - F.count("*").over(by_key) + F.row_number().over(by_key.orderBy("n", "shingle"))
    early = common.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
    early = cut(early.select("shingle", "key", "class", "size", "place"), "early")
    met = early.groupBy("shingle").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("shingle")
    early = cut(early.join(met, "shingle"), "met")
    share = similarity / (1 + similarity)
    large = early.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("key", "class", "size", "place")))
    small = early.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * (2 * share) - 1e-9) + 1)
    smaller = (F.col("size") < F.col("size2")) | (F.col("size") == F.col("size2")) & (F.col("key") < F.col("key2"))
    rest = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
    least = (F.col("size") + F.col("size2")) * share - 1e-9
    found = small.join(large, "shingle").where((F.col("class") != F.col("class2")) & smaller & (F.col("size") >= F.col("size2") * similarity - 1e-9) & (rest + 1 >= least))
    # if a match is early enough, so are all before it: what a pair shares up to the last of these has been counted, behind it at most the rest of either text is shared
    met = found.groupBy("key", "key2").agg(F.count("*").alias("n"), F.max("place").alias("place"), F.max("place2").alias("place2"), F.max("size").alias("size"), F.max("size2").alias("size2"))
    met = met.where(F.col("n") + rest >= least)
    return met.select(F.least("key", "key2").alias("u"), F.greatest("key", "key2").alias("v"))


def _drawn():
    """The order in which a document becomes a leader, the same in all its buckets, so that few different pairs are compared."""
    return F.xxhash64("key")


def _turn():
    return F.pmod(_drawn(), F.lit(LEADERS))


def _waiting():
    """Whether a member has not been a leader: in each of LEADERS turns they come in falling order of their draw."""
    return _drawn() < F.element_at(F.array(*[f"last{k}" for k in range(LEADERS)]), (_turn() + 1).cast("int"))


def _next_pairs(members: DataFrame, labels: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that still hold two classes, with the new leaders' draws; and each member against these leaders."""
    members = cut(members.join(labels, "key"), "members")
    top = [F.max(F.when(_waiting() & (_turn() == k), F.struct(_drawn().alias("drawn"), F.col("key").alias("lead"), F.col("class").alias("lead_class")))).alias(f"top{k}") for k in range(LEADERS)]
    heads = cut(members.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y"), *top).where("x <> y").drop("x", "y"), "heads")
    met = cut(members.select("band", "key", "class").join(heads, "band"), "met")
    last = [F.coalesce(F.col(f"top{k}.drawn"), F.lit(-(1 << 63))).alias(f"last{k}") for k in range(LEADERS)]
    pairs = met.select("key", "class", F.explode(F.array(*[f"top{k}" for k in range(LEADERS)])).alias("l")).where("l is not null and class <> l.lead_class")
    pairs = pairs.select(F.least("key", "l.lead").alias("u"), F.greatest("key", "l.lead").alias("v")).distinct()
    return met.select("band", "key", *last), cut(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")


def _result(signed: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    classes = cut(sets.join(labels.withColumnRenamed("key", "rep"), "rep", "left").select("size", "a", "b", "copies", "lead", F.coalesce("class", "rep").alias("class")), "classes")
    heads = cut(classes.groupBy("class").agg(F.min("lead").alias("head")), "heads")
    found = classes.join(heads, "class").select("size", "a", "b", "copies", "head")
    out = signed.join(cut(found, "found"), ["size", "a", "b"], "left")
    alone = F.col("head").isNull()
    head = lambda c: F.col(f"head.{c}").eqNullSafe(F.col(c))
    return out.select(
        *IDENTITY, F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), (alone | head("doc_id") & head("h1") & head("h2")).alias("kept"),
        "n_rows", (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their classes, all columns as they are; of equal documents one row."""
    kept = cut(near_duplicates(docs, id_col, text_col, similarity).where("kept").select(*IDENTITY, "n_rows"), "kept")
    names = [f"_scholia_{c}" for c in IDENTITY]
    keyed = docs.withColumns(dict(zip(names, _identified(docs, id_col, text_col), strict=True)))
    wanted = kept.select(*(F.col(c).alias(f"{n}_kept") for n, c in zip(names, IDENTITY, strict=True)), F.col("n_rows").alias("_scholia_rows"))
    found = keyed.join(wanted, [F.col(n).eqNullSafe(F.col(f"{n}_kept")) for n in names])
    if not kept.where("n_rows > 1").limit(1).count():
        return found.select(*docs.columns)
    several = found.where("_scholia_rows > 1").dropDuplicates(names)
    return found.where("_scholia_rows = 1").select(*docs.columns).union(several.select(*docs.columns))
