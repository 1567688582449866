"""Span finders: text -> array of spans, inside one row, without Python."""

from __future__ import annotations

from collections.abc import Callable

from velum.functions import patterns as P
from velum.functions.arrays import empty, let, running
from velum.functions.dates import parse_date
from velum.labels import OUTPUT_LABEL, PATTERN_RANK

HIT = "struct<start:int,end:int,text:string>"
SPAN = (
    "struct<start:int,end:int,rank:int,seq:int,entity_type:string,text:string,model:string>"
)


def matches(text: str, pattern: str) -> str:
    return f"{text} RLIKE r'{pattern}'"


# A character no text should hold, put around each match, and one that no pattern
# here tells apart from it, put in its place where a text does hold it.
MARK, STAND_IN = "\uffff", "\ufffe"


def find_all(text: str, pattern: str, gate: str | None = None) -> str:
    """All matches of a JVM ``pattern``, left to right, with code-point offsets.

    Rows that fail ``gate``, a cheaper condition that holds for every row with a
    match, are done. In the others one pass puts a mark around each match, and
    cutting the text at the marks gives gaps and matches in turn, whose lengths add
    up to the offsets."""
    def gap(k):
        return f"length(cuts[{k} - 1])"

    def step(k):
        return f"{gap(k)} + length(cuts[{k}])"

    found = running(
        "sequence(1, size(cuts) - 1, 2)",
        "0",
        lambda at, k: f"{at} + {step(k)}",
        lambda at, k, _: f"named_struct('start', {at} + {gap(k)}, 'end', {at} + {step(k)}, "
        f"'text', cuts[{k}])",
        HIT,
    )
    has_mark = f"contains({text}, '{MARK}')"
    # Only a text with a mark of its own needs its matches cut out again.
    exact = let(
        "found",
        found,
        f"""CASE WHEN {has_mark} THEN transform(found, h -> named_struct('start', h.start,
        'end', h.`end`, 'text', substring({text}, h.start + 1, h.`end` - h.start))) ELSE found END""",
    )
    clean = f"CASE WHEN {has_mark} THEN replace({text}, '{MARK}', '{STAND_IN}') ELSE {text} END"
    marked = f"regexp_replace({clean}, r'{pattern}', '{MARK}$0{MARK}')"
    hits = let(
        "cuts",
        f"split({marked}, '{MARK}', -1)",
        f"CASE WHEN size(cuts) > 1 THEN {exact} ELSE {empty(HIT)} END",
    )
    condition = gate or matches(text, pattern)
    return f"CASE WHEN {condition} THEN {hits} ELSE {empty(HIT)} END"


def _reshape(hits: str, start: str, end: str, text: str) -> str:
    return (
        f"transform({hits}, h -> named_struct('start', {start}, 'end', {end}, 'text', {text}))"
    )


def find_telephone(text: str) -> str:
    return find_all(text, P.JVM_TELEPHONE)


def find_zipcode(text: str) -> str:
    """Five digits between two other characters, which belong to the match but not
    to the span."""
    hits = find_all(text, P.JVM_ZIP_CODE, matches(text, P.GATE_ZIP_CODE))
    return _reshape(hits, "h.start + 1", "h.`end` - 1", "substring(h.text, 2, 5)")


def find_email(text: str) -> str:
    gate = f"contains({text}, '@') AND {matches(text, P.GATE_EMAIL)}"
    return find_all(text, P.JVM_EMAIL, gate)


def find_fiscal_code(text: str) -> str:
    return find_all(text, P.JVM_FISCAL_CODE)


def find_age(text: str) -> str:
    return _lower_text(find_all(text, P.JVM_AGE, matches(text, P.GATE_AGE)))


def find_date_candidates(text: str) -> str:
    return _lower_text(find_all(text, P.JVM_DATE, matches(text, P.GATE_DATE)))


def find_dates(text: str, reference_date) -> str:
    """Candidates that can be read as a day-first date."""
    return (
        f"filter({find_date_candidates(text)}, "
        f"h -> {parse_date('h.text', reference_date)} IS NOT NULL)"
    )


def find_readings(text: str, reference_date) -> str:
    """Candidates that can be read as a date, with what they are read as."""
    read = (
        f"transform({find_date_candidates(text)}, h -> named_struct('start', h.start, "
        f"'end', h.`end`, 'text', h.text, 'date', {parse_date('h.text', reference_date)}))"
    )
    return f"filter({read}, h -> h.date IS NOT NULL)"


def _lower_text(hits: str) -> str:
    return _reshape(hits, "h.start", "h.`end`", "lower(h.text)")


# Entity -> finder; each takes the text and the reference date.
FINDERS: dict[str, Callable[[str, object], str]] = {
    "telephone": lambda text, _: find_telephone(text),
    "zipcode": lambda text, _: find_zipcode(text),
    "email": lambda text, _: find_email(text),
    "fiscal_code": lambda text, _: find_fiscal_code(text),
    "date": find_dates,
    "age": lambda text, _: find_age(text),
}


def as_spans(hits: str, entity: str) -> str:
    """Give the hits of one finder their label, rank and position."""
    return (
        f"transform({hits}, (h, i) -> named_struct('start', h.start, 'end', h.`end`, "
        f"'rank', {PATTERN_RANK[entity]}, 'seq', i, 'entity_type', '{OUTPUT_LABEL[entity]}', "
        "'text', h.text, 'model', 'regex'))"
    )


def pattern_spans(text: str, entities: list[str], reference_date) -> str:
    """Spans of the given entities in one array; duplicates are kept.

    Most texts have none of the characters that every match has one of. One pass tells,
    before any finder looks at the text."""
    if not entities:
        return empty(SPAN)
    found = [as_spans(FINDERS[e](text, reference_date), e) for e in entities]
    needed = "".join(sorted({P.NEEDED[e] for e in entities}))
    return f"CASE WHEN {matches(text, f'[{needed}]')} THEN concat({', '.join(found)}) ELSE {empty(SPAN)} END"
