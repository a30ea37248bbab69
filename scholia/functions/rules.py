"""Rule cascades over labels, titles and records, as CASE expressions in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Fixed values of the data model: labels, patterns and names in the order in which they are tried.
#: (pattern of a lower-cased label, track, decision)
TRACK_RULES = [
    ("submitted to|under review", "main", "under_review"),
    ("findings", "findings", "accepted"),
    ("workshop", "workshop", "accepted"),
    ("shared task", "shared_task", "accepted"),
    ("industry track", "industry", "accepted"),
    ("system demonstration|demonstrations", "demo", "accepted"),
    ("tutorial", "tutorial", "accepted"),
    ("poster|oral|spotlight|notable top|^accept", "main", "accepted"),
    ("^main$", "main", "accepted"),
    (r"^proceedings of the \d+(st|nd|rd|th) annual meeting of the association for computational linguistics \(volume [12]: (long|short) papers\)$", "main", "accepted"),
    (r"^proceedings of the \d{4} conference on empirical methods in natural language processing$", "main", "accepted"),
    (r"^proceedings of the \d{4} conference of the (north american chapter|nations of the americas chapter) of the association for computational linguistics: human language technologies \(volume [12]: (long|short) papers\)$", "main", "accepted"),
    (".", "other", "accepted"),
]
DECISION_RULES = [
    ("withdraw", "withdrawn"),
    ("desk.*reject|reject.*desk", "desk_rejected"),
    ("reject", "rejected"),
    ("^accept|accepted|oral|spotlight|poster", "accepted"),
    ("under review|submitted|pending|in review", "under_review"),
]
PRESENTATIONS = ["oral", "spotlight", "poster"]


def cascade(value: Column, rules: Sequence[tuple[str, object]], otherwise: object) -> Column:
    """The result of the first rule whose pattern is found in value."""
    out = None
    for pattern, result in rules:
        out = F.when(value.rlike(pattern), F.lit(result)) if out is None else out.when(value.rlike(pattern), F.lit(result))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def classify_track(label: Column) -> Column:
    """struct(track, decision) of a raw label."""
    flat = F.lower(collapse(F.coalesce(label, F.lit(""))))
    return F.struct(cascade(flat, [(p, t) for p, t, _ in TRACK_RULES], "unknown").alias("track"), cascade(flat, [(p, d) for p, _, d in TRACK_RULES], "unknown").alias("decision"))


def normalize_decision(value: Column) -> Column:
    """A venue's own decision or label as one of the model's decisions."""
    return cascade(F.replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit("_"), F.lit(" ")), DECISION_RULES, "unknown")


def presentation_type(value: Column) -> Column:
    return cascade(F.lower(F.coalesce(value, F.lit(""))), [(x, x) for x in PRESENTATIONS], None)


def payload_filter(year: Column, venue: Column, low: int | None = None, high: int | None = None, venues: Sequence[str] | None = None, flags: Sequence[Column] = ()) -> Column:
    """Year range with either bound open, venue set, and further flags; a null year fails a bound."""
    venues = sorted({v.strip() for v in venues if v.strip()}) if venues is not None else None
    if low is not None and high is not None and low > high:
        raise ValueError("the first year is after the last")
    out = F.lit(True)
    for part in ([year >= low] if low is not None else []) + ([year <= high] if high is not None else []) + ([venue.isin(venues)] if venues else []) + list(flags):
        out = out & part
    return F.coalesce(out, F.lit(False))


def above_floor(score: Column, floor: float | None) -> Column:
    return F.lit(True) if floor is None else score > floor


def problems(checks: Sequence[tuple[str, Column]]) -> Column:
    """Codes of the checks that fail (null counts as failing), as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks]))
