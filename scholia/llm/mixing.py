"""Language-model scores by logistic context mixing of hashed-context bit predictors.

A text is coded byte by byte, ended by a byte that UTF-8 never uses; each byte is eight binary
decisions.  For each decision the contexts of the last 0 to 5 bytes (together with the bits already
known) give counts of zeros and ones in the training texts; their log-odds are mixed by weights that
a gate selects (which bit, how many contexts have been seen, how often the longest of them), and the
result is refined by a table over (bits known, mixed probability) adapted to what actually came.
Along a text, TEMPERS sharper and flatter forms of this are mixed by weights that follow, byte by
byte, how well each has predicted the text so far; the product of these steps equals the mean of the
forms' whole-text probabilities, which is how it is computed.  bits per byte and log10 p follow.

The model grows with the input: every six-byte string of all texts is kept with its training count.
The strings are dealt into cells by a hash of their last three context bytes, about CELL strings a
cell, so that all contexts of three to five bytes are counted exactly inside one cell (three bytes
leave room for 2**24 strings at most).  Shorter contexts come from the counts of three-byte strings,
which are broadcast: 2**24 strings of 12 bytes at most, far fewer in UTF-8.  Mixing weights are
learnt online, cell by cell in an order fixed by hash, each string seen as if one occurrence of it
had not been counted, and averaged over the cells; the refinement is gathered in a second pass, and
a third prices each distinct string once, in cells of its own.  What is learnt comes from the training
strings alone, their number included, and none of this depends on the number of partitions.

Texts are dealt into blocks of about BLOCK_BYTES, words and strings by hash into as many buckets.
Each block sends its distinct words and strings once, packed into a row for each bucket, receives
the words' counts and the strings' prices in the same way, and meets its texts again: no table of
all words or strings is ever in one place, and a common word is one key of each block.  Rows that
are equal in id and text share a block.

Defined results: null or empty texts are the end byte and the end token alone; without training
texts all predictors say one half; repeated rows count as often as they occur; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACED, U64, Block, cut, groups, held_out_column, mix, texts_of
from .units import kept_in_worker

ORDERS = 6
LOW = 3  # orders below this come from three-byte strings
CELL = 1 << 17
BLOCK_BYTES = 1 << 25
END_TOKEN = np.uint64(0x0E4D0E4D0E4D0E4D)
STEPS = 33  # of the refinement table, over log-odds from -8 to 8
LEVELS = 4  # of how often the longest context has been seen
SETS = 8 * (ORDERS + 1) * LEVELS
TALLY = 1 << 19  # keys that wait to be summed, at least
BATCH = 512
SLICE = 1 << 16
TEMPERS = (0.85, 1.15)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the five before it (zeros before the start) as one number, ends included; and each text's number of them."""
    joined = b"".join(b"\0\0\0\0\0" + t + b"\xff" for t in texts)
    buf = np.frombuffer(joined, np.uint8)
    packed = np.zeros(max(len(buf) - 5, 0), np.uint64)
    for k in range(6):
        packed |= buf[5 - k : len(buf) - k].astype(np.uint64) << U64(8 * k)
    count = np.array([len(t) + 1 for t in texts], np.int64)
    real = np.ones(len(packed), bool)
    ends = np.cumsum(count + 5)[:-1]
    for k in range(5):
        real[ends - 5 + k] = False
    return packed[real], count


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Tally:
    """Numbers summed by key, in memory of about three times the distinct keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = [summed(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.held = 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.held += len(key)
        if self.held > len(self.parts[0][0]) + TALLY:
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts, self.held = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))], 0
        return self.parts[0]


class Level:
    """Counts of the strings of one length; a context's zeros and ones are ranges of the sorted strings."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int):
        self.mask = U64((1 << (8 * (order + 1))) - 1)
        self.key, n = summed(key & self.mask, n)
        self.cum = np.r_[0, np.cumsum(n)]

    def split(self, gram: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        low = gram & self.mask & ~U64((1 << (8 - bit)) - 1)
        a, b, c = (self.cum[np.searchsorted(self.key, low + U64(x))] for x in (0, 1 << (7 - bit), 1 << (8 - bit)))
        return b - a, c - b


def levels(key: np.ndarray, n: np.ndarray, orders: range) -> list[Level]:
    seen = n > 0
    return [Level(key[seen], n[seen], k) for k in orders]


def _squash(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def inputs(known_levels: list[Level], gram: np.ndarray, bit: int, without: bool = False):
    """Mixer inputs (n x ORDERS + 1), gates, bits that came, bits known; `without` leaves one occurrence out."""
    byte = gram & U64(0xFF)
    known = ((byte | U64(0x100)) >> U64(8 - bit)).astype(np.int64)
    came = ((byte >> U64(7 - bit)) & U64(1)).astype(np.int64)
    x = np.empty((len(gram), ORDERS + 1))
    x[:, ORDERS] = 0.3
    seen, longest = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    for k, level in enumerate(known_levels):
        zeros, ones = level.split(gram, bit)
        if without:
            zeros, ones = np.maximum(zeros - (came == 0), 0), np.maximum(ones - (came == 1), 0)
        total = zeros + ones
        x[:, k] = np.log((ones + 0.1) / (zeros + 0.1)) * (total > 0)
        seen += total > 0
        longest = np.where(total > 0, total, longest)
    often = np.searchsorted(np.array([2, 4, 16]), longest, side="right")
    return x, (bit * (ORDERS + 1) + seen) * LEVELS + often, came, known


@dataclass
class Mixer:
    weights: np.ndarray  # SETS x (ORDERS + 1)
    refine: np.ndarray  # 256 * STEPS x 2: ones, all

    def mixed(self, x, gate):
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -12, 12)

    @staticmethod
    def cells(z, known):
        """The two neighbouring places of the refinement table, with their shares."""
        place = (np.clip(z, -8, 8) + 8) * ((STEPS - 1) / 16)
        low = np.minimum(place.astype(np.int64), STEPS - 2)
        return (known * STEPS + low, 1 - (place - low)), (known * STEPS + low + 1, place - low)

    def refined(self, z, known):
        p = _squash(z)
        got = np.zeros(len(z))
        for at, share in self.cells(z, known):
            cell = self.refine[at]
            got += share * (cell[:, 0] + 8 * p) / (cell[:, 1] + 8)
        return np.clip((p + got) / 2, 1e-6, 1 - 1e-6)

    def prices(self, known_levels: list[Level], gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte, given the five before, in each of the TEMPERS (a row each)."""
        total = np.zeros((len(TEMPERS), len(gram)))
        for bit in range(8):
            x, gate, came, known = inputs(known_levels, gram, bit)
            p = self.refined(self.mixed(x, gate), known)
            odds = np.where(came == 1, 1, -1) * np.log(p / (1 - p))
            for k, temper in enumerate(TEMPERS):
                total[k] -= np.log1p(np.exp(-temper * odds)) / np.log(10)
        return total


def text_score(prices: np.ndarray) -> np.ndarray:
    """log10 of the mean of the forms' probabilities of each text (forms x texts)."""
    top = prices.max(axis=0)
    return top + np.log10(np.mean(10.0 ** (prices - top), axis=0))


def learn(known_levels: list[Level], gram: np.ndarray, n: np.ndarray, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt online over the strings, in an order fixed by their hashes, and the mass each set has seen."""
    weights, mass = np.full((SETS, ORDERS + 1), 0.3), np.zeros(SETS)
    square = np.full((SETS, ORDERS + 1), 1e-3)
    order = np.argsort(mix(gram.copy()))
    for start in range(0, len(order), SLICE):
        part = order[start : start + SLICE]
        ready = [inputs(known_levels, gram[part], bit, without=True)[:3] for bit in range(8)]
        for a in range(0, len(part), BATCH):
            some = slice(a, a + BATCH)
            own_n = n[part[some]].astype(np.float64)
            for x, gate, came in ((x[some], gate[some], came[some]) for x, gate, came in ready):
                pull = own_n * (came - _squash(np.einsum("ij,ij->i", x, weights[gate])))
                sets, at = np.unique(gate, return_inverse=True)
                own = np.bincount(at, own_n)
                slope = np.stack([np.bincount(at, pull * x[:, j]) for j in range(ORDERS + 1)], axis=1) / own[:, None]
                square[sets] = 0.95 * square[sets] + 0.05 * slope**2
                weights[sets] += rate * slope / np.sqrt(square[sets] + 1e-9)
                mass[sets] += own
    return weights, mass


def adapt(known_levels: list[Level], mixer: Mixer, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts for the refinement table: ones and all."""
    ones, total = np.zeros(256 * STEPS), np.zeros(256 * STEPS)
    for a in range(0, len(gram), SLICE):
        g, w = gram[a : a + SLICE], n[a : a + SLICE]
        for bit in range(8):
            x, gate, came, known = inputs(known_levels, g, bit, without=True)
            for cell, share in mixer.cells(mixer.mixed(x, gate), known):
                total += np.bincount(cell, w * share, 256 * STEPS)
                ones += np.bincount(cell, w * share * came, 256 * STEPS)
    return ones, total


def _in_cells(counted: DataFrame, run, low, schema: str) -> DataFrame:
    """run(levels, strings, training counts) -> arrays, for each cell."""
    name = uuid.uuid4().hex
    strings = max(1, counted.count())
    cell = F.pmod(F.xxhash64(F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(-(-strings // CELL)))

    def of_cell(table):
        gram, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        short = kept_in_worker(name, lambda: levels(*low.value, range(LOW)))
        return pa.table(run(short + levels(gram, n, range(LOW, ORDERS)), gram, n))

    return counted.withColumn("cell", cell).groupBy("cell").applyInArrow(of_cell, schema)


def train(counted: DataFrame, buckets: int) -> DataFrame:
    """The price of every string of `counted` (key, n: training count), with its bucket; what reaches the driver has a bounded size."""
    spark = counted.sparkSession
    three = counted.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast((three["key"].to_numpy().astype(np.uint64), three["n"].to_numpy()))

    def total(run, size):
        def sums(known_levels, gram, n):
            seen = n > 0
            x, y = run(known_levels, gram[seen], n[seen])
            at = np.flatnonzero(y)
            return {"at": at, "x": x[at], "y": y[at]}

        rows = _in_cells(counted.where("n > 0"), sums, low, "at long, x double, y double").groupBy("at").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toArrow()
        x, y = np.zeros(size), np.zeros(size)
        x[rows["at"].to_numpy()], y[rows["at"].to_numpy()] = rows["x"].to_numpy(), rows["y"].to_numpy()
        return x, y

    def weighed(known_levels, gram, n):
        weights, mass = learn(known_levels, gram, n)
        mass = np.repeat(mass, ORDERS + 1)
        return weights.reshape(-1) * mass, mass

    weights, mass = total(weighed, SETS * (ORDERS + 1))
    weights = np.where(mass > 0, weights / np.maximum(mass, 1), 0.3).reshape(SETS, -1)
    mixer = Mixer(weights, np.zeros((256 * STEPS, 2)))
    mixer = Mixer(weights, np.stack(total(lambda known_levels, gram, n: adapt(known_levels, mixer, gram, n), 256 * STEPS), axis=1))

    def priced(known_levels, gram, n):
        parts = [mixer.prices(known_levels, gram[a : a + SLICE]) for a in range(0, len(gram), SLICE)]
        found = np.concatenate(parts, axis=1) if parts else np.zeros((len(TEMPERS), 0))
        return {"bucket": bucket_of(gram, buckets), "key": gram.view(np.int64)} | {f"p{k}": row.astype(np.float32) for k, row in enumerate(found)}

    return _in_cells(counted, priced, low, "bucket int, key long, " + ", ".join(f"p{k} float" for k in range(len(TEMPERS))))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and one end of each text, and the texts that they are in."""
    block = Block(texts, lower=True)
    starts, ends, doc = block.spans(SPACED)
    return np.r_[block.hashes(starts, ends), np.full(len(texts), END_TOKEN)], np.r_[doc, np.arange(len(texts))]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.copy()) % U64(buckets)).astype(np.int32)


def pack(x: np.ndarray) -> bytes:
    """Ascending keys as differences, other numbers as they are."""
    return zlib.compress((np.diff(x, prepend=U64(0)) if x.dtype == np.uint64 else x).tobytes(), 1)


def unpack(raws: list[bytes], kind) -> list[np.ndarray]:
    found = [np.frombuffer(zlib.decompress(raw), kind) for raw in raws]
    return [np.cumsum(x, dtype=np.uint64) for x in found] if kind == np.uint64 else found


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def parts_of(table: pa.Table):
    """The table's texts group by group, each with its rows; only one group's texts are copied at a time."""
    for part in table.to_batches():
        texts = texts_of(part["text"])
        for a, b in groups(texts):
            yield texts[a:b], part[a:b]


def _block_counts(buckets: int):
    """The block's distinct words and six-byte strings, with their numbers in its training texts, a row for each bucket."""

    def run(key, table):
        found = {True: Tally(), False: Tally()}
        for texts, part in parts_of(table):
            train_ = part["training"].to_numpy(zero_copy_only=False)
            token, doc = _tokens(texts)
            found[True].add(*summed(token, train_[doc].astype(np.int64)))
            for own in (True, False):
                some = [t for t, is_training in zip(texts, train_, strict=True) if is_training == own]
                if some:
                    gram = np.sort(grams(some)[0])
                    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                    found[False].add(gram[first], np.diff(np.r_[first, len(gram)]) * own)
        rows = []
        for word, tally in found.items():
            token, n = tally.sums()
            home = bucket_of(token, buckets)
            order = np.argsort(home, kind="stable")
            bounds = np.searchsorted(home[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                pick = order[bounds[k] : bounds[k + 1]]
                rows.append((key[0].as_py(), k, word, pack(token[pick]), pack(n[pick].astype(np.uint32))))
        return pa.table(dict(zip(("block", "bucket", "word", "keys", "n"), zip(*rows, strict=True), strict=True)), _ENTRIES)

    return run


_ENTRIES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("word", pa.bool_()), ("keys", pa.binary()), ("n", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("word", pa.bool_()), ("keys", pa.binary()), *((f"x{k}", pa.binary()) for k in range(len(TEMPERS))), ("tokens", pa.int64()), ("kinds", pa.int64())])
TOLD = "block long, word boolean, keys binary, " + ", ".join(f"x{k} binary" for k in range(len(TEMPERS))) + ", tokens long, kinds long"


def _word_totals(table):
    """Each block's known words of this bucket with their training counts; and a row without a block of the bucket's sums."""
    keys, n = unpack(table["keys"].to_pylist(), np.uint64), unpack(table["n"].to_pylist(), np.uint32)
    token, c = summed(np.concatenate(keys), np.concatenate(n).astype(np.int64))
    token, c = token[c > 0], c[c > 0]
    unused = [None] * (len(TEMPERS) - 1)
    rows = [(None, True, None, None, *unused, int(c.sum()), len(c))]
    for block, key in zip(table["block"].to_pylist(), keys, strict=True):
        key = key[np.isin(key, token, assume_unique=True)]
        rows.append((block, True, pack(key), pack(c[np.searchsorted(token, key)]), *unused, None, None))
    return pa.table(dict(zip(_TOLD.names, zip(*rows, strict=True), strict=True)), _TOLD)


def _string_totals(table):
    key, n = summed(np.concatenate(unpack(table["keys"].to_pylist(), np.uint64)), np.concatenate(unpack(table["n"].to_pylist(), np.uint32)).astype(np.int64))
    return pa.table({"key": key.view(np.int64), "n": n})


def _tell_prices(left, right):
    """The prices of each block's strings of this bucket, in the order of their keys."""
    known = right["key"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, prices = known[order], [right[f"p{k}"].to_numpy()[order] for k in range(len(TEMPERS))]
    rows = []
    for block, raw in zip(left["block"].to_pylist(), left["keys"].to_pylist(), strict=True):
        at = np.searchsorted(known, unpack([raw], np.uint64)[0])
        rows.append((block, False, raw, *(pack(p[at]) for p in prices), None, None))
    return pa.table(dict(zip(_TOLD.names, zip(*rows, strict=True), strict=True)), _TOLD) if rows else _TOLD.empty_table()


class Prices:
    """The prices of a block's strings: by a table of hash places, and by bisection where two share a place."""

    def __init__(self, key: np.ndarray, prices: list[np.ndarray]):
        order = np.argsort(key)
        self.key, self.prices = key[order], [p[order] for p in prices]
        bits = max(4, int(4 * len(key)).bit_length())
        self.shift = U64(64 - bits)
        self.place = np.zeros(1 << bits, np.int32)
        self.place[self._slot(self.key)] = np.arange(len(key))

    def _slot(self, gram):
        return (gram * U64(0x9E3779B97F4A7C15)) >> self.shift

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        """Forms x texts."""
        gram, count = grams(texts)
        at = self.place[self._slot(gram)]
        miss = np.flatnonzero(self.key[at] != gram)
        at[miss] = np.searchsorted(self.key, gram[miss])
        start = np.cumsum(count) - count
        return np.stack([np.add.reduceat(p[at], start, dtype=np.float64) for p in self.prices])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (5, 1), training: DataFrame | None = None) -> DataFrame:
    """One row per document: base and model log10 probabilities, bits per byte and token counts.

    Learns from the documents outside the fold, or from `training` (a table with text_col), if given; then all of docs are held out.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.lit(True).alias("scored"))
    own = own.withColumn("held_out", held_out_column("doc_id", *fold) if training is None else F.lit(True)).withColumn("training", ~F.col("held_out"))
    if training is not None:
        more = training.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(training[text_col].cast("string"), F.lit("")).alias("text"))
        own = own.unionByName(more.withColumn("scored", F.lit(False)).withColumn("held_out", F.lit(False)).withColumn("training", F.lit(True)))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(8, -(-size // BLOCK_BYTES))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    entries = cut(dealt.groupBy("block").applyInArrow(_block_counts(blocks), "block long, bucket int, word boolean, keys binary, n binary"), "entries")
    strings = entries.where("not word")
    counted = cut(strings.groupBy("bucket").applyInArrow(_string_totals, "key long, n long"), "strings")
    priced = cut(train(counted, blocks), "priced")
    words = cut(entries.where("word").groupBy("bucket").applyInArrow(_word_totals, TOLD), "words")
    row = words.where("block is null").agg(F.sum("tokens"), F.sum("kinds")).first()
    n_all, n_distinct = row[0] or 0, row[1] or 0
    base_log = float(np.log10(n_all + 0.5 * (n_distinct + 1)))
    prices_told = strings.select("block", "bucket", "keys").groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInArrow(_tell_prices, TOLD)
    told = words.where("block is not null").unionByName(prices_told).drop("tokens", "kinds")

    def run(key, left, right):
        rows = {is_word: right.filter(pa.compute.equal(right["word"], is_word)) for is_word in (True, False)}
        token = joined(unpack(rows[True]["keys"].to_pylist(), np.uint64), np.uint64)
        c = joined(unpack(rows[True]["x0"].to_pylist(), np.int64), np.int64)
        order = np.argsort(token)
        token, c = token[order], c[order]
        string = joined(unpack(rows[False]["keys"].to_pylist(), np.uint64), np.uint64)
        found = [joined(unpack(rows[False][f"x{k}"].to_pylist(), np.float32), np.float32) for k in range(len(TEMPERS))]
        prices = Prices(string, found)
        left = left.filter(left["scored"])
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "n_known", "base_score", "score")}
        for texts, _ in parts_of(left):
            mine, doc = _tokens(texts)
            at = np.minimum(np.searchsorted(token, mine), max(len(token) - 1, 0))
            count = np.where(token[at] == mine, c[at], 0) if len(token) else np.zeros(len(mine), np.int64)
            n = np.bincount(doc, minlength=len(texts))
            out["n_bytes"].append(np.array([len(t) for t in texts], np.int64))
            out["n_tokens"].append(n)
            out["n_known"].append(np.bincount(doc[count > 0], minlength=len(texts)))
            out["base_score"].append(np.bincount(doc, np.log10(count + 0.5) - base_log, len(texts)))
            out["score"].append(text_score(prices.of_texts(texts)))
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"]} | {k: pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if "score" in k else pa.int64()) for k, v in out.items()})

    schema = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
    bits = -F.col("score") * float(np.log2(10))
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long")).withColumn("bits_per_byte", bits / (F.col("n_bytes") + 1))
