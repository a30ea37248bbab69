"""Whole-text byte kernels shared by the operators of this subpackage.

A batch of texts becomes one byte buffer with a newline after each text; words, lines and
hashes are then numpy passes over that buffer.  All separators are ASCII, so working on UTF-8
bytes gives the same words as working on code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are handled in groups of about this many bytes (a longer text is a group of its own).
GROUP_BYTES = 1 << 21
#: Spans of up to this many bytes are hashed by a polynomial.
SHORT = 64

#: Words that are separated by ASCII white space only.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and everything beyond ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, as a table for bytes.translate and for numpy.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_NP = np.frombuffer(LOWER, np.uint8)

_BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << n.bit_length(), 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is changed in place and returned."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def gathered(parts: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes (Spark's own hold few rows, in case texts are long)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving back at a task's end what its Python worker would else keep for the next: workers outlive their stage."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Forget the power tables and return free memory to the system (a module's function, so that no table is sent with a task)."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # the C library of Linux has this call
        ctypes.CDLL(None).malloc_trim(0)


class Block:
    """Texts as one buffer; `offsets[d]` is where text d starts, `offsets[-1]` the buffer's end."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined.translate(LOWER) if lower else joined, np.uint8)
        self.raw = memoryview(self.buf)
        self.n_docs = len(texts)
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        self._prefix = None

    def spans(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the runs of bytes marked in is_word."""
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = is_word[self.buf]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, self.doc_of(starts)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that each of the ascending positions is in."""
        bounds = np.searchsorted(positions, self.offsets)
        return np.repeat(np.arange(self.n_docs), np.diff(bounds))

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, self.n_docs).astype(np.int64)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes.

        A polynomial modulo 2**64 for short spans; some pairs of long strings have the same value
        of any such polynomial, so spans of more than SHORT bytes go through xxhash.
        """
        prefix, inverse = self._sums()
        h = mix((prefix[ends] - prefix[starts]) * inverse[starts])
        long = np.flatnonzero(ends - starts > SHORT)
        if len(long):
            raw, digest = self.raw, xxhash.xxh3_64_intdigest
            h[long] = [digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return h

    def rolling(self, width: int) -> np.ndarray:
        """The hashes of all spans of `width` bytes, text borders included."""
        prefix, inverse = self._sums()
        h = prefix[width:] - prefix[:-width]
        h *= inverse[: len(h)]
        return mix(h)

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        pw, inverse = _power_tables(len(self.buf) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + U64(1)) * pw[:-1], out=self._prefix[1:])
        return self._prefix, inverse


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the positions of their first words; none crosses a text."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    factor = 1
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * U64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    first = np.flatnonzero(doc[: len(total)] == doc[n - 1 :])
    return mix(total[first]), first


def plain_text(raw: bytes) -> str:
    """Lower-cased A-Z words of PLAIN, one space before, between and after them; '' without words."""
    parts = raw.translate(_TO_SPACE).split(b" ")
    words = b" ".join(filter(None, parts))
    return f" {words.decode()} " if words else ""


_TO_SPACE = bytes(LOWER[b] if PLAIN[LOWER[b]] else 0x20 for b in range(256))


def crc_of_id(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else zlib.crc32(b"")


def held_out_column(id_col: str, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % modulus == remainder


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a folder of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/scholia-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor then costs no
    recomputation of what came before, and joins see plain scans, whose skew Spark can split."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def row_key(id_col, text_col):
    """The id as a number; a null id gives a number below -2**62 that is drawn from the text."""
    return F.coalesce(id_col.cast("long"), -F.pmod(F.xxhash64(text_col), F.lit(1 << 62)) - (1 << 62) - 1)
