"""Text functions as Column expressions; a pandas UDF only where no built-in has the semantics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that compatibility normalisation leaves alone; other texts need the UDF.
_STABLE = "^[\\x00-\\x7F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0391-\\u03A1\\u03A3-\\u03CE\\u0400-\\u0482\\u048A-\\u052F\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u2030-\\u2032\\u20AC\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FFF\\uAC00-\\uD7A3]*$"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def nfkc(text: Column) -> Column:
    """Compatibility normalisation; Python only sees texts that it may change."""
    return F.when(text.rlike(_STABLE), text).otherwise(_nfkc(F.when(~text.rlike(_STABLE), text)))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; accented letters separate.  The text is taken as it is."""
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))


#: Bytes of terms as they are, all others as blanks; bytes beyond ASCII separate.
_TERM_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))


def token_arrays(texts: list, compatible: bool = False) -> tuple[pa.Array, np.ndarray]:
    """tokens() of each of a batch of strings (null: none), one after another, and how many each has; compatible normalises before."""
    import unicodedata

    if compatible:
        texts = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts]
    parts = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass").translate(_TERM_BYTES) for t in texts]
    buf = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    is_term = buf != 32
    edges = np.flatnonzero(is_term[1:] != is_term[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    begin = np.cumsum([1, *(len(x) + 1 for x in parts)])
    offsets = np.r_[0, np.cumsum(ends - starts)]
    kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    flat = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(buf[is_term])])
    return flat, np.diff(np.searchsorted(starts, begin))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def title_key(text: Column, exact: bool = False) -> Column:
    """Collapsed, case-folded title; null if blank.  exact folds case as Python does (sharp s to ss)."""
    flat = collapse(nfkc(text) if exact else text)
    folded = _casefold(flat) if exact else F.replace(F.lower(flat), F.lit("ß"), F.lit("ss"))
    return F.nullif(folded, F.lit(""))


def paper_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n", title, F.nullif(abstract, F.lit("")))


def normalize_doi(raw: Column) -> Column:
    """The bare lower-case DOI, or null if it is none."""
    bare = F.lower(F.regexp_replace(F.trim(raw), "^(?i)(https?://(dx\\.)?doi\\.org/|doi:\\s*)", ""))
    return F.when(bare.rlike("^10\\.\\d{4,9}/\\S+$"), bare)


def normalize_arxiv(raw: Column) -> Column:
    """struct(id, version) of an arXiv identifier in any of its spellings; null if it is none."""
    bare = F.regexp_replace(F.trim(raw), "^(?i)(https?://arxiv\\.org/(abs|pdf)/|arxiv:\\s*)", "")
    form = "^((?:\\d{4}\\.\\d{4,5})|(?:[a-z-]+(?:\\.[A-Z]{2})?/\\d{7}))(?:v(\\d+))?(?:\\.pdf)?$"
    return F.when(bare.rlike(form), F.struct(F.regexp_extract(bare, form, 1).alias("id"), F.nullif(F.regexp_extract(bare, form, 2), F.lit("")).cast("int").alias("version")))


def split_authors(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def ends_mid_sentence(text: Column) -> Column:
    """Whether the text's end is no sentence end (closing quotes and brackets looked through)."""
    ends = [".", "!", "?", ".\"", ".'", ".)", "”", ":"]
    out = F.lit(False)
    for e in ends:
        out = out | F.endswith(F.rtrim(text), F.lit(e))
    return ~out


def starts_mid_sentence(text: Column) -> Column:
    return ~F.ltrim(text).rlike("^[\\p{Lu}\\p{Nd}\\p{P}\\p{S}]")


def naive_sentences(text: Column, least: int = 3, most: int = 120) -> Column:
    """Lines (headings dropped) cut after .!?, lower-cased tokens joined by blanks, by length in tokens."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith("#"))
    pieces = F.flatten(F.transform(lines, lambda x: F.split(x, "(?<=[.!?])\\s+")))
    joined = F.transform(pieces, lambda x: F.array_join(tokens(x), " "))
    size = lambda x: F.size(F.filter(F.split(x, " "), lambda y: y != ""))
    return F.filter(joined, lambda x: (size(x) >= least) & (size(x) <= most))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID, version 5, from SHA-1 of the namespace's 16 bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def money(value: Column) -> Column:
    return value.cast("decimal(12,6)")


def backoff_seconds(attempt: Column, retry_after: Column | None = None) -> Column:
    own = F.least(F.lit(60.0), F.pow(F.lit(2.0), F.greatest(F.lit(1), attempt)))
    return own if retry_after is None else F.greatest(own, F.coalesce(retry_after.cast("double"), F.lit(0.0)))


def parse_permutation(answer: Column, n: Column) -> Column:
    """Numbers of an answer in order, each once and within 1..n, then the rest in order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit("\\d+"), F.lit(0)), lambda x: x.cast("int"))
    valid = F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n)))
    return F.concat(valid, F.array_except(F.sequence(F.lit(1), n), valid))


def format_history(turns: DataFrame, key: str, turn: str, role: str, text: str, limit: int) -> DataFrame:
    """(key, history): `Role: text` lines of each conversation, oldest first, cut from the front to `limit` characters.

    A line has more than three characters, so that only the last limit / 4 turns can be in the result;
    no conversation is gathered beyond them.
    """
    line = F.concat(F.initcap(role), F.lit(": "), collapse(F.coalesce(text, F.lit(""))))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(turn)))
    few = turns.withColumn("_n", back).where(F.col("_n") <= limit // 4 + 1)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("x")))), lambda r: r["x"]), "\n")
    cut = F.right(F.col("_w"), F.lit(limit))
    return few.groupBy(key).agg(whole.alias("_w")).select(key, F.when(F.startswith(cut, F.lit("\n")), F.substr(cut, F.lit(2))).otherwise(cut).alias("history"))
