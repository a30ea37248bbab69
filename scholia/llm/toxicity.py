"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  Each sentence gets a probability from a logistic model over its
hashed words; the text's score is their noisy-or, 1 - prod(1 - p).  Only text labels are known:
the gradient of the noisy-or tells each sentence its share, so the model learns which sentences
are at fault and reports them.

The model is fitted on the driver from labelled texts taken in an order given by a hash of the id:
at most MAX_LABELLED of them, and only while they hold at most MAX_SAMPLE_BYTES together, which
bounds the driver's memory; a text of more than a tenth of that is passed over before the count.
Scoring covers every text in full and shuffles nothing.

Defined results: a null or empty text has no sentences and score 0; a document with several
labels counts as toxic if any says so; null labels are unlabelled; without labels, or with one
class only, every sentence has the prior's probability; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import PLAIN, U64, Block, groups, held_out_column, mix, texts_of

BITS = 18
MAX_LABELLED = 6000
MAX_SAMPLE_BYTES = 1 << 26
MIN_TEXTS = 3  # texts that a word must be in to be learnt
MIN_Z = 4.0  # standard errors by which its share of toxic texts must differ from the prior
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)  # bytes of a word that are features besides the word
SUFFIXES = (5,)
SENTENCE_END = np.zeros(256, np.int64)
SENTENCE_END[list(b".!?\n")] = 1

SCHEMA = "doc_id long, score double, n_sentences long, worst_p double, worst_start long, worst_end long, offending array<array<long>>"


@dataclass
class Model:
    weights: np.ndarray  # float32, 2**BITS
    bias: float


def bags(texts: list[bytes]):
    """Block, and for each word: its feature and sentence; for each sentence: its text, first and last byte."""
    block = Block(texts, lower=True)
    starts, ends, doc = block.spans(PLAIN)
    stops = np.cumsum(SENTENCE_END[block.buf])
    number = stops[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.r_[True, number[1:] != number[:-1]] if len(starts) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(starts)] - 1 if len(heads) else heads
    shift = U64(64 - BITS)
    features, owners = [block.hashes(starts, ends) >> shift], [sentence]
    for k, size in enumerate(PREFIXES + SUFFIXES):  # stems tell where endings vary
        long = np.flatnonzero(ends - starts > size)
        a, b = (starts[long], starts[long] + size) if k < len(PREFIXES) else (ends[long] - size, ends[long])
        features.append(mix(block.hashes(a, b) + U64(k + 1)) >> shift)
        owners.append(sentence[long])
    return block, np.concatenate(features).astype(np.int64), np.concatenate(owners), doc[heads], starts[heads], ends[tails]


def _sentence_p(model: Model, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    z = model.bias + np.bincount(sentence, model.weights[feature], n)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_texts(model: Model, texts: list[bytes], offending_p: float = 0.5) -> dict[str, list]:
    block, feature, sentence, owner, first, last = bags(texts)
    p = _sentence_p(model, feature, sentence, len(owner))
    score = -np.expm1(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), block.n_docs))
    chars = np.r_[0, np.cumsum((block.buf & 0xC0) != 0x80)]
    begin, end = (chars[x] - chars[block.offsets[owner]] for x in (first, last))
    worst = np.full(block.n_docs, -1)
    order = np.lexsort((-np.arange(len(p)), p, owner))
    worst[owner[order]] = order  # the last of each text: the greatest p, the first of equals
    some = worst >= 0
    pick = lambda values: [values[w].item() if s else None for w, s in zip(worst, some, strict=True)]
    spans: list[list] = [[] for _ in texts]
    for s in np.flatnonzero(p >= offending_p):
        spans[owner[s]].append([int(begin[s]), int(end[s])])
    return {"score": np.clip(score, 0, 1), "n_sentences": np.bincount(owner, minlength=block.n_docs), "worst_p": pick(p), "worst_start": pick(begin), "worst_end": pick(end), "offending": spans}


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """Noisy-or likelihood by Adam, over the words whose share of toxic texts differs clearly from the prior."""
    weights = np.zeros(1 << BITS, np.float64)
    y = np.asarray(labels, bool)
    spread, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    sentences = docs = 0
    for a, b in groups(texts):  # first the words to learn, then their occurrences: memory follows the few words
        _, feature, sentence, owner, _, _ = bags(texts[a:b])
        pair = np.unique((owner[sentence] << BITS) | feature)
        word, text = pair & ((1 << BITS) - 1), (pair >> BITS) + a
        spread += np.bincount(word, minlength=1 << BITS)
        bad += np.bincount(word, y[text], 1 << BITS)
        sentences, docs = sentences + len(owner), b
    prior = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
    bias = float(np.log(prior / max(sentences / max(docs, 1), 1)))
    if not sentences or y.all() or not y.any():
        return Model(weights.astype(np.float32), bias)
    telling = (spread >= MIN_TEXTS) & (np.abs(bad - spread * prior) >= MIN_Z * np.sqrt(np.maximum(spread, 1) * prior * (1 - prior)))
    parts, n = [], 0
    for a, b in groups(texts):
        _, feature, sentence, owner, _, _ = bags(texts[a:b])
        use = telling[feature]
        pair = np.unique((sentence[use] << BITS) | feature[use])  # a word counts once in a sentence
        parts.append((pair & ((1 << BITS) - 1), (pair >> BITS) + n, owner + a))
        n += len(owner)
    feature, sentence, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    known, column = np.unique(feature, return_inverse=True)
    theta, m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    theta[-1] = bias
    toxic = y[owner]
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sentence, theta[column], sentences)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-12, 1 - 1e-9)
        q = np.exp(np.bincount(owner, np.log1p(-p), docs))
        pull = np.where(toxic, -np.minimum(q / np.maximum(1 - q, 1e-6), 1e3)[owner] * p, p)
        slope = np.r_[np.bincount(column, pull[sentence], len(known)), pull.sum()] / docs + decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[known] = theta[:-1]
    return Model(weights.astype(np.float32), float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_SAMPLE_BYTES, fold: tuple[int, int] = (4, 2)) -> Model:
    """Fit on labelled rows outside the held-out fold, at most max_labelled of them and max_bytes of text."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    given = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y is not null")
    pool = given.where(~held_out_column("doc_id", *fold)).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = own.where("doc_id is not null").groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    drawn = F.xxhash64("doc_id").alias("drawn")
    some = pool.join(sizes, "doc_id").where(F.col("size") <= max_bytes // 10).select("doc_id", "y", "size", drawn).orderBy("drawn", "doc_id").limit(max_labelled).toArrow()
    some = some.sort_by([("drawn", "ascending"), ("doc_id", "ascending")])
    some = some.filter(pa.array(np.cumsum(some["size"].to_numpy()) <= max_bytes)).select(["doc_id", "y"])  # at most max_labelled rows
    chosen = docs.sparkSession.createDataFrame(some) if some.num_rows else pool.limit(0)
    table = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    first = np.r_[True, np.diff(table["doc_id"].to_numpy()) != 0] if table.num_rows else np.zeros(0, bool)
    table = table.filter(pa.array(first))  # of rows with one id, the first text
    return fit(texts_of(table["text"].combine_chunks()) if table.num_rows else [], table["y"].to_numpy() > 0)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: score, the worst sentence and all offending ones (character spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the input

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), texts_of(part.column(1))
            for a, b in groups(texts):
                out = score_texts(shared.value, texts[a:b])
                kinds = {"score": pa.float64(), "worst_p": pa.float64(), "offending": pa.list_(pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b]} | {k: pa.array(x, kinds.get(k, pa.int64())) for k, x in out.items()})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def score_column(model: Model, text):
    """The score as a column of any DataFrame with a text column; 0 for null."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        raw = [b"" if t is None else t.encode() for t in texts]
        return pd.Series(np.concatenate([score_texts(shared.value, raw[a:b])["score"] for a, b in groups(raw)]) if raw else [], dtype="float64")

    return score(text.cast("string"))
