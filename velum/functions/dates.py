"""Reading and generalising dates."""

from __future__ import annotations

import datetime as dt

from velum.functions.arrays import let
from velum.functions.patterns import ASCII_DIGITS, OTHER_DIGITS
from velum.labels import MONTHS


def normalise_months(text: str) -> str:
    """Month names and abbreviations as two digits."""
    for name, number in MONTHS:
        text = f"replace({text}, '{name}', '{number}')"
    return text


def parse_date(text: str, reference_date: dt.date) -> str:
    """Read a date candidate leniently, day first, as ``struct<year,month,day>``;
    NULL when it is no date.

    Fields the text lacks come from ``reference_date``, which also decides the
    century of a two-digit year. Never read the wall clock in a task: a retried
    task could then give another answer than the first one."""
    ascii_text = (
        f"CASE WHEN length({text}) = octet_length({text}) THEN {text} "
        f"ELSE translate({text}, '{OTHER_DIGITS}', '{ASCII_DIGITS}') END"
    )
    numeric = f"CASE WHEN w RLIKE '[a-z]' THEN {normalise_months('w')} ELSE w END"
    # Separators as one character, so that no pattern is compiled per row.
    parts = (
        "named_struct('part', split(translate(t, '-/.', '   '), ' '), "
        "'seps', translate(t, '0123456789', ''))"
    )
    read = let("cut", parts, let("v", _values("cut.part", "cut.seps"), _assign("v", reference_date)))
    return let("w", ascii_text, let("t", numeric, read))


def _number(part: str) -> str:
    return f"try_cast({part} AS int)"


def _digits(part: str) -> str:
    """A part read as digits: more than two of them must be a year."""
    return f"named_struct('v', {_number(part)}, 'big', length({part}) > 2)"


def _quantity(part: str) -> str:
    """A part read as a number: more than 100 must be a year."""
    return f"named_struct('v', {_number(part)}, 'big', {_number(part)} > 100)"


def _decimal(whole: str, fraction: str) -> str:
    """Two parts around a dot read as one number, whose fraction is dropped."""
    w, f = _number(whole), _number(fraction)
    return f"named_struct('v', {w}, 'big', {w} > 100 OR ({w} = 100 AND {f} > 0))"


def _is_decimal(whole: str, fraction: str) -> str:
    """Six or eight characters would be read as a packed time instead."""
    return f"length({whole}) + length({fraction}) + 1 NOT IN (6, 8)"


def _values(part: str, seps: str) -> str:
    """The numbers of a candidate, by the separators between them; NULL when the
    combination has no reading."""
    a, b, c = (f"get({part}, {i})" for i in range(3))
    return f"""CASE
        WHEN {seps} IN ('-', '/') THEN array({_digits(a)}, {_digits(b)})
        WHEN {seps} IN ('--', '//', '..') THEN array({_digits(a)}, {_digits(b)}, {_digits(c)})
        WHEN {seps} = ' ' THEN array({_quantity(a)}, {_quantity(b)})
        WHEN {seps} = '  ' THEN array({_quantity(a)}, {_quantity(b)}, {_quantity(c)})
        WHEN {seps} = '.' AND {_is_decimal(a, b)} THEN array({_decimal(a, b)})
        WHEN {seps} IN ('-/', '/-', '- ', '/ ')
            THEN array({_digits(a)}, {_digits(b)}, {_quantity(c)})
        WHEN {seps} IN (' -', ' /') THEN array({_quantity(a)}, {_digits(b)}, {_digits(c)})
        WHEN {seps} = '. ' AND {_is_decimal(a, b)} THEN array({_decimal(a, b)}, {_quantity(c)})
        WHEN {seps} = ' .' AND {_is_decimal(b, c)} THEN array({_quantity(a)}, {_decimal(b, c)})
    END"""


def _ymd(year: str, month: str, day: str) -> str:
    return (
        f"named_struct('year', cast({year} AS int), 'month', cast({month} AS int), "
        f"'day', cast({day} AS int))"
    )


def _assign(values: str, reference: dt.date) -> str:
    """Decide which number is the year, the month and the day."""
    p, q, r = (f"get({values}, {i}).v" for i in range(3))
    year_first = f"({p} > 31 OR get({values}, 0).big)"
    n_big = f"size(filter({values}, x -> x.big))"
    fields = f"""CASE size({values})
        WHEN 1 THEN CASE WHEN {p} > 31 THEN {_ymd(p, 'NULL', 'NULL')}
            ELSE {_ymd('NULL', 'NULL', p)} END
        WHEN 2 THEN CASE WHEN {p} > 31 THEN {_ymd(p, q, 'NULL')}
            WHEN {q} > 31 THEN {_ymd(q, p, 'NULL')}
            WHEN {q} <= 12 THEN {_ymd('NULL', q, p)}
            ELSE {_ymd('NULL', p, q)} END
        ELSE CASE WHEN {year_first} AND {r} <= 12 THEN {_ymd(p, r, q)}
            WHEN {year_first} THEN {_ymd(p, q, r)}
            WHEN {p} > 12 OR {q} <= 12 THEN {_ymd(r, q, p)}
            ELSE {_ymd(r, p, q)} END
    END"""
    completed = let("f", fields, _complete("f", f"{n_big} > 0", reference))
    return f"CASE WHEN {values} IS NOT NULL AND {n_big} <= 1 THEN {completed} END"


def _complete(fields: str, has_big: str, reference: dt.date) -> str:
    """Fill in century and missing fields and check that the day exists."""
    given = f"{fields}.year"
    near = f"{given} + {reference.year // 100 * 100}"
    year = f"""CASE WHEN {given} IS NULL THEN {reference.year}
        WHEN {given} >= 100 OR {has_big} THEN {given}
        WHEN {near} >= {reference.year + 50} THEN {near} - 100
        WHEN {near} < {reference.year - 50} THEN {near} + 100
        ELSE {near} END"""
    month = f"coalesce({fields}.month, {reference.month})"
    last = """CASE WHEN m.month = 2 AND ((m.year % 4 = 0 AND m.year % 100 <> 0) OR m.year % 400 = 0)
        THEN 29 WHEN m.month = 2 THEN 28 WHEN m.month IN (4, 6, 9, 11) THEN 30 ELSE 31 END"""
    day = f"coalesce({fields}.day, least({reference.day}, {last}))"
    return let(
        "m",
        f"named_struct('year', {year}, 'month', {month})",
        f"""CASE WHEN m.year BETWEEN 1 AND 9999 AND m.month BETWEEN 1 AND 12
            AND {day} BETWEEN 1 AND {last} THEN {_ymd('m.year', 'm.month', day)} END""",
    )


def generalise(date: str, level: str) -> str:
    """A parsed date as its year, or as month and year."""
    if level == "year":
        return f"cast({date}.year AS string)"
    return f"concat_ws('-', {date}.month, {date}.year)"
