"""Token-id files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

Texts are encoded where they are read and kept as rows (doc_id, number and bytes of the ids); each
encoding task adds one row with its token counts.  The counts over all rows give the ranks: the
most frequent id is 0.  Only these rows are then range-partitioned by id, and each task writes its
range.  Ranks are written four to a control byte that holds two bits each (code length less one),
with the code bytes in a stream of their own.  A 256-row table turns control bytes into lengths,
so decoding is a few numpy passes.

A file is one or more blocks, so neither writing nor reading holds more than one.  Layout of a
block (little-endian): 8 bytes magic, then six int64: documents, tokens, number of the
first token in its shard, control bytes, code bytes, shard; doc ids int64[documents]; token counts
int64[documents]; null marks uint8[documents]; control bytes; code bytes.  In the same folder
`ranks.bin` is the id of each rank as uint32, and `starts.bin` the pairs (shard, number of its
first token) as int64.  Files are named by shard and place, so ascending names are ascending
documents, and a task that runs again writes the same bytes under the same name; a file appears by
renaming, never half written.

Defined results: a null text is empty and holds the end id alone; null ids come first; documents
with one id are ordered by a hash of their token ids, and equal rows are kept (so one id's rows
may be split over several tasks); an empty table makes no file; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import Block, cut, gathered, groups, shared_folder, texts_of
from .units import Store, forget_kept, kept_in_worker, ranges, spans_array

MAGIC = b"SCHTOK1\0"
#: Bytes of compressed rows that make one block, and one file.
BLOCK_BYTES, FILE_BYTES = 1 << 21, 1 << 26
END_ID = 2
GROUP = 1 << 23
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1

JOINED = 1000  # units that go through the library as one text
BLANK, BEYOND, OTHER, LETTER, DIGIT = range(5)
KIND = np.full(256, OTHER, np.int8)
KIND[[*range(33), 127]] = BLANK
KIND[128:] = BEYOND
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
_PLAIN = re.compile(b" ?[^\x00- \x7f]+").fullmatch
_WIDE_SPACE = re.compile("[^\\S\x00-\x7f]")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and code bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


class Tokens:
    """Whole texts through the tokenizers library; each distinct stretch of text (told by its bytes) is encoded once.

    Where the file names the usual byte-level pattern, a text may be cut where that pattern always
    begins a new match: before a single space between two characters that are no white space,
    where a run of ASCII letters or digits ends at another visible ASCII character, and around a
    line break between such characters.  With any other file, and where a text has other than
    ASCII white space or holds one of the file's added tokens (which the library takes as such,
    wherever they stand), texts are encoded whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        own = json.loads(spec)
        self.added = [t["content"].encode() for t in own.get("added_tokens") or []]
        first = own.get("pre_tokenizer") or {}
        self.may_cut = own.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex") is True and not first.get("add_prefix_space") and not any(b"\n" in t for t in self.added)
        self.line = self.model.encode("\n", add_special_tokens=False).ids
        self.store = Store()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _units(self, units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Units without white space but a leading space go through the library many at a time, a line break (always a token of its own there) between them."""
        if not self.may_cut or len(self.line) != 1:
            return [self._ids([u.decode() for u in units])]
        plain = np.fromiter((_PLAIN(u) is not None for u in units), bool, len(units))
        rows = [units[k] for k in np.flatnonzero(plain)]
        lines = [b"\n".join(rows[a : a + JOINED]).decode() + "\n" for a in range(0, len(rows), JOINED)]
        flat, _ = self._ids(lines)
        stop = np.flatnonzero(flat == self.line[0])
        size = np.empty(len(units), np.int64)
        size[plain] = np.diff(stop, prepend=-1) - 1
        other, size[~plain] = self._ids([units[k].decode() for k in np.flatnonzero(~plain)])
        ids = np.empty(int(size.sum()), np.int32)
        at = np.cumsum(size) - size
        ids[ranges(at[plain], size[plain])] = np.delete(flat, stop)
        ids[ranges(at[~plain], size[~plain])] = other
        return [(ids, size)]

    def _edges(self, block: Block) -> np.ndarray:
        """Where units begin, the line break after each text being one."""
        buf = block.buf
        start = np.zeros(len(buf) + 1, bool)
        if self.may_cut and len(buf) > 2:
            kind = KIND[buf]
            before, here, after = kind[:-2], kind[1:-1], kind[2:]
            start[1:-2] = ((buf[1:-1] == 32) & (before != BLANK) & (after != BLANK)) | ((before != here) & (here >= OTHER) & ((before == LETTER) | (before == DIGIT)))
            line = np.flatnonzero((buf[1:-1] == 10) & (before != BLANK) & (after != BLANK)) + 1
            start[line] = start[line + 1] = True
        start[block.offsets] = True
        start[block.offsets[1:] - 1] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and each text's number of them."""
        self.store.trim()
        whole = {k for k, t in enumerate(texts) if self.may_cut and (any(a in t for a in self.added) or not t.isascii() and _WIDE_SPACE.search(t.decode()))}
        block = Block([b"" if k in whole else t for k, t in enumerate(texts)] if whole else texts)
        edges = self._edges(block)
        slots = self.store.slots(spans_array(block.buf, edges), self._units)
        ends = np.searchsorted(edges, block.offsets[1:] - 1)
        slots[ends] = self._end(end_id)
        ids, sizes = self.store.spell(slots)
        count = np.diff(np.cumsum(sizes)[ends], prepend=0)
        if not whole:
            return ids, count
        own = np.split(ids, np.cumsum(count)[:-1])
        for k in whole:
            own[k] = np.r_[self._ids([texts[k].decode()])[0], np.int32(end_id)]
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)

    def _end(self, end_id: int) -> int:
        """The slot of the end, kept under a key that is no text."""
        return int(self.store.slots(pa.array([b"\xff"], pa.binary()), lambda _: [(np.array([end_id], np.int32), np.ones(1, np.int64))])[0])


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode_rows(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """A row (doc_id, n, h, payload) for each document, and one with the counts of all ids for each task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the tokenizer's file, whatever the input

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_worker(("tokens", spec.value), lambda: Tokens(spec.value))
        squeeze = zstandard.ZstdCompressor(1)
        total = np.zeros(0, np.int64)
        for part in gathered(parts, GROUP):
            texts = texts_of(part.column(1))
            for a, b in groups(texts, GROUP):
                ids, n = tokens.encode(texts[a:b], end_id)
                total = _add(total, np.bincount(ids))
                view = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                edges = np.r_[0, np.cumsum(n)] * 4
                h = np.array([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in pairwise(edges.tolist())], np.uint64)
                narrow = int(ids.max(initial=0)) <= 0xFFFF
                if narrow:
                    view, edges = memoryview(np.ascontiguousarray(ids, "<u2").view(np.uint8)), edges // 2
                payload = pa.array([squeeze.compress(view[x:y]) for x, y in pairwise(edges.tolist())], pa.binary())
                yield _encoded(part.column(0)[a:b], n, h.view(np.int64), payload, None, narrow)
        yield _encoded(pa.nulls(1, pa.int64()), np.zeros(1, np.int64), np.zeros(1, np.int64), pa.nulls(1, pa.binary()), squeeze.compress(total.astype("<i8").tobytes()), False)

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, h long, narrow boolean, payload binary, counts binary")


def _encoded(doc_id, n, h, payload, counts, narrow) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": doc_id, "n": pa.array(n), "h": pa.array(h), "narrow": pa.array(np.full(len(n), narrow)), "payload": payload,
        "counts": pa.nulls(len(n), pa.binary()) if counts is None else pa.array([counts], pa.binary()),
    })


def _add(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    if len(more) > len(total):
        total = np.pad(total, (0, len(more) - len(total)))
    total[: len(more)] += more
    return total


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, expand = np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress
    for part in parts:
        for raw in part.column(0).to_pylist():
            total = _add(total, np.frombuffer(expand(raw), "<i8"))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"token": pa.array(some), "n": pa.array(total[some])})


def _ids_of(part: pa.RecordBatch, expand) -> Iterator[np.ndarray]:
    for raw, narrow in zip(part.column("payload").to_pylist(), part.column("narrow").to_pylist(), strict=True):
        yield np.frombuffer(expand(raw), "<u2" if narrow else "<u4")


def _close(out, store, tmp: str, path: str) -> None:
    out.close()
    store.move(tmp, path)


def _file_row(name: str, shard: int, held: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"name": pa.array([name]), "shard": pa.array([shard], pa.int64()), "n_docs": pa.array([held[0]]), "n_tokens": pa.array([held[1]])})


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files in `folder` (a URI that all executors reach) and return the list of files."""
    spark = docs.sparkSession
    rows = cut(encode_rows(docs, tokenizer_path, id_col, text_col, end_id), "ids")
    counts = rows.select("counts").where("counts is not null").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # one row for each id of the vocabulary at most
    token, n = table["token"].to_numpy(), table["n"].to_numpy()
    ids = token[np.lexsort((token, -n))].astype("<u4")
    shared = spark.sparkContext.broadcast(ids)
    store, base = _fs(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/ranks.bin") as out:
        out.write(ids.tobytes())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()  # the encoder of the stage before
        store, base = _fs(folder)
        ids, expand = shared.value, zstandard.ZstdDecompressor().decompress
        rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        rank[ids] = np.arange(len(ids), dtype=np.uint32)
        shard, seq, before = TaskContext.get().partitionId(), 0, 0
        out = None
        for part in gathered(parts, BLOCK_BYTES):
            ranks = rank[np.concatenate(list(_ids_of(part, expand)))]
            control, data = pack(ranks)
            names = part.column("doc_id")
            head = np.array([part.num_rows, len(ranks), before, len(control), len(data), shard], "<i8")
            if out is None:
                name, held = f"{shard:07d}-{seq:012d}.tok", [0, 0, 0]
                out = store.open_output_stream(tmp := f"{base}/.{name}.{uuid.uuid4().hex}")
            for piece in (head, names.fill_null(0).to_numpy().astype("<i8"), part.column("n").to_numpy().astype("<i8"), names.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)):
                out.write(MAGIC + piece.tobytes() if piece is head else piece.tobytes())
            out.write(control)
            out.write(data)
            held = [held[0] + part.num_rows, held[1] + len(ranks), held[2] + part.nbytes]
            seq, before = seq + part.num_rows, before + len(ranks)
            if held[2] >= FILE_BYTES:
                out = _close(out, store, tmp, f"{base}/{name}")
                yield _file_row(name, shard, held)
        if out is not None:
            _close(out, store, tmp, f"{base}/{name}")
            yield _file_row(name, shard, held)

    placed = rows.where("counts is null").drop("counts").withColumn("r", F.monotonically_increasing_id()).repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r")
    files = cut(placed.select("doc_id", "n", "narrow", "payload").mapInArrow(run, "name string, shard long, n_docs long, n_tokens long"), "files")
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toArrow()  # one row for each partition
    n = sums["n"].to_numpy()
    with store.open_output_stream(f"{base}/starts.bin") as out:
        out.write(np.stack([sums["shard"].to_numpy(), np.cumsum(n) - n], axis=1).astype("<i8").tobytes())
    return files


def blocks(stream, ids: np.ndarray, starts: dict[int, int]):
    """A file's documents, block by block: ids (None for null), first token numbers, token counts, all token ids."""
    while magic := stream.read(8):
        if magic != MAGIC:
            raise ValueError("not a token file")
        n_docs, n, first, n_control, n_data, shard = np.frombuffer(stream.read(48), "<i8").tolist()
        names, sizes, null = (np.frombuffer(stream.read(w * n_docs), k) for w, k in ((8, "<i8"), (8, "<i8"), (1, np.uint8)))
        tokens = ids[unpack(stream.read(n_control), stream.read(n_data), n)]
        yield pa.array(names, pa.int64(), mask=null.astype(bool)), starts[shard] + first + np.cumsum(sizes) - sizes, sizes, tokens


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _fs(folder)
        with store.open_input_stream(f"{base}/ranks.bin") as f:
            ids = np.frombuffer(f.read(), "<u4")
        with store.open_input_stream(f"{base}/starts.bin") as f:
            starts = dict(np.frombuffer(f.read(), "<i8").reshape(-1, 2).tolist())
        for part in parts:
            for name in part.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}") as f:
                    for docs, start, sizes, tokens in blocks(f, ids, starts):
                        at = np.r_[0, np.cumsum(sizes)]
                        little = memoryview(np.ascontiguousarray(tokens, "<u4").view(np.uint8))
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": docs, "start": pa.array(start), "n_tokens": pa.array(sizes), "ids_crc32": pa.array([zlib.crc32(little[a:b]) for a, b in pairwise((4 * at).tolist())], pa.int64()),
                            "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens, pa.uint32()).cast(pa.int64())) if with_ids else pa.nulls(len(docs), pa.list_(pa.int64())),
                        })

    n = max(1, files.count())
    return files.select("name").repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, with the file system that Spark takes it to be on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark) + "/tokens")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)
