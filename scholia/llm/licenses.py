"""Licence scans: exact phrases, and short notices found with a few edits.

A notice of m characters that occurs with at most k edits holds one of any k + 1 pieces of it
unchanged (pigeonhole).  All pieces of all notices and the exact phrases are searched in one
Aho-Corasick pass over the normalised text (lower-cased words, single spaces); around every
piece found, the regex library matches the whole notice with at most k errors, which verifies
the edits and gives the span.  In each stretch around pieces the best match is taken, then the
best ones before and behind it, until none is left, so matches of a notice never overlap.

Defined results: null or empty texts have no words, no labels and score 0; repeated rows give
repeated results; extra columns are ignored; matches are ordered by place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import plain_text, texts_of
from .units import kept_in_worker

#: Phrases whose exact occurrences count, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices as they stand in source files and pages, normalised, with their labels.
NOTICES = [
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the terms of the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
CHARS_PER_EDIT = 12

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,notice:int,start:int,end:int,errors:int>>"
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def edits(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of nearly equal length, with their offsets."""
    k = edits(notice) + 1
    at = [len(notice) * j // k for j in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES):
        import ahocorasick
        import regex

        table: dict[str, tuple[list, list]] = {}
        for phrase, label in phrases.items():
            table.setdefault(f" {phrase} ", ([], []))[0].append((label, len(phrase.split())))
        for n, (_, notice) in enumerate(notices):
            for at, piece in pieces(notice):
                table.setdefault(piece, ([], []))[1].append((n, at))
        self.found = ahocorasick.Automaton()
        for key, value in table.items():
            self.found.add_word(key, (len(key), *value))
        self.found.make_automaton()
        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(x, literal_spaces=True)}){{e<={edits(x)}}}") for _, x in notices]

    def scan(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """(character, label) of each phrase, and (notice, start, end, errors) of each fuzzy match."""
        exact, near = [], {}
        for end, (size, labels, seeds) in self.found.iter(text):
            exact += [(end + 1 - size, label) for label, _ in labels]
            for n, at in seeds:
                near.setdefault(n, []).append(end + 1 - size - at)
        matches = []
        for n, begins in near.items():
            size, k = len(self.notices[n][1]), edits(self.notices[n][1])
            for a, b in _joined(sorted((x - k, x + size + k) for x in begins)):
                open_ = [(max(a, 0), min(b, len(text)))]
                while open_:  # the best match of a stretch, then what is before and behind it
                    a, b = open_.pop()
                    m = self.patterns[n].search(text, a, b) if b - a >= size - k else None
                    if m and m.end() > m.start():
                        matches.append((n, *m.span(), sum(m.fuzzy_counts)))
                        open_ += [(a, m.start()), (m.end(), b)]
        return exact, sorted(matches, key=lambda x: (x[1], x[2], x[0]))


def _joined(spans):
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document; matches give character spans of the original text. No shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept_in_worker(("licences", tuple(phrases.items()), tuple(notices)), lambda: Scanner(phrases, notices))
        fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
        for part in parts:
            rows: dict[str, list] = {k: [] for k in fields}
            for raw in texts_of(part.column(1)):
                text = plain_text(raw)
                exact, near = scanner.scan(text) if text else ([], [])
                words = text.count(" ") - 1 if text else 0
                first = last = None
                spans = []
                if exact or near:
                    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                    if exact:
                        at = np.searchsorted(gaps, [x for x, _ in exact])
                        first, last = int(at.min()), int(at.max())
                    original = [m.span() for m in _WORD.finditer(raw.decode())] if near else []
                    for n, a, b, errors in near:
                        a, b = (max(int(np.searchsorted(gaps, x, "right")) - 1, 0) for x in (a, b - 1))
                        a, b = min(a, words - 1), min(b, words - 1)
                        spans.append({"label": notices[n][0], "notice": n, "start": original[a][0], "end": original[b][1], "errors": errors})
                base = sorted({x for _, x in exact})
                score = 1.0 if exact else max((1 - e / len(notices[n][1]) for n, _, _, e in near), default=0.0)
                for k, v in zip(fields, (words, len(exact), first, last, ",".join(base), ",".join(sorted({*base, *(notices[n][0] for n, *_ in near)})), score, spans), strict=True):
                    rows[k].append(v)
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            kinds["matches"] = pa.list_(pa.struct([("label", pa.string()), *((x, pa.int32()) for x in ("notice", "start", "end", "errors"))]))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def contract(found: DataFrame) -> DataFrame:
    return found.drop("matches").withColumn("n_matches", F.lit(None).cast("long")) if "matches" not in found.columns else found.withColumn("n_matches", F.size("matches").cast("long")).drop("matches")
