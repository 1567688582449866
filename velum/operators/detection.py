"""Patterns searched, resolved and masked a batch at a time with Arrow: an expression is run
over all texts of a part together, not one finder after the other inside each row.

The results are those of the expressions in ``functions`` (``pattern_spans``, ``resolve``,
``mask``), which read one text inside a larger expression."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.config import DeidConfig, check_date_level, check_mode
from velum.functions import patterns as P
from velum.functions.finders import SPAN
from velum.labels import MONTHS, OUTPUT_LABEL, PATTERN_RANK

MASKED = f"struct<masked_text:string,spans:array<{SPAN}>>"

# Bytes of text that are searched at once.
PART = 1 << 20

_NEEDED = np.zeros(256, bool)
_NEEDED[[*b"0123456789@", *range(0x80, 0x100)]] = True
_TO_ASCII = str.maketrans(P.OTHER_DIGITS, P.ASCII_DIGITS)


def _runs(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, "i8"), np.cumsum(counts, dtype="i8")))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, of which none is null, and where each begins and ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = np.empty(0, "u1") if data is None else np.frombuffer(data, "u1")
    return data[at[0] : at[-1]], at - at[0]


def _mark(data: np.ndarray) -> str:
    """A character that is not in the texts."""
    used = np.bincount(data, minlength=256)
    control = next((c for c in range(1, 32) if not used[c]), None)
    if control is not None:
        return chr(control)
    whole = data.tobytes()
    return next(c for c in map(chr, range(0xE000, 0x110000)) if c.encode() not in whole)


def _matches(texts: pa.Array, pattern: str, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Where matches begin and end in the bytes of all texts. A mark is put around each."""
    marked, _ = _bytes(pc.replace_substring_regex(texts, pattern, rf"{mark}\0{mark}"))
    code = mark.encode()
    hit = marked[: len(marked) - len(code) + 1] == code[0]
    for i in range(1, len(code)):
        hit &= marked[i : len(marked) - len(code) + 1 + i] == code[i]
    place = np.flatnonzero(hit)
    place -= len(code) * np.arange(len(place))
    return place[::2], place[1::2]


def _number(part: str) -> int | None:
    return int(part) if part and len(part.lstrip("0")) < 11 and int(part) < 1 << 31 else None


def _digits(part: str):
    return _number(part), len(part) > 2


def _quantity(part: str):
    n = _number(part)
    return n, n is not None and n > 100


def _decimal(whole: str, fraction: str):
    w, f = _number(whole), _number(fraction)
    return w, w is not None and (w > 100 or (w == 100 and f is not None and f > 0))


def _values(parts: list[str], seps: str):
    """The numbers of a candidate, as ``dates._values``."""
    a, b, c = (*parts, "", "", "")[:3]
    packed = (6, 8)
    if seps in ("-", "/"):
        return [_digits(a), _digits(b)]
    if seps in ("--", "//", ".."):
        return [_digits(a), _digits(b), _digits(c)]
    if seps == " ":
        return [_quantity(a), _quantity(b)]
    if seps == "  ":
        return [_quantity(a), _quantity(b), _quantity(c)]
    if seps == "." and len(a) + len(b) + 1 not in packed:
        return [_decimal(a, b)]
    if seps in ("-/", "/-", "- ", "/ "):
        return [_digits(a), _digits(b), _quantity(c)]
    if seps in (" -", " /"):
        return [_quantity(a), _digits(b), _digits(c)]
    if seps == ". " and len(a) + len(b) + 1 not in packed:
        return [_decimal(a, b), _quantity(c)]
    if seps == " ." and len(b) + len(c) + 1 not in packed:
        return [_quantity(a), _decimal(b, c)]
    return None


def _assigned(values) -> tuple:
    """Year, month and day, as ``dates._assign``. A number that is too long is null and is
    not more than any other."""

    def over(n, limit):
        return n is not None and n > limit

    def upto(n, limit):
        return n is not None and n <= limit

    p = values[0][0]
    if len(values) == 1:
        return (p, None, None) if over(p, 31) else (None, None, p)
    q = values[1][0]
    if len(values) == 2:
        if over(p, 31):
            return p, q, None
        if over(q, 31):
            return q, p, None
        return (None, q, p) if upto(q, 12) else (None, p, q)
    r = values[2][0]
    if over(p, 31) or values[0][1]:
        return (p, r, q) if upto(r, 12) else (p, q, r)
    return (r, q, p) if over(p, 12) or upto(q, 12) else (r, p, q)


@lru_cache(1 << 16)
def read_date(text: str, reference: dt.date) -> tuple[int, int, int] | None:
    """Year, month and day of a date candidate in lower case, by the rule of
    ``dates.parse_date``; None when it is no date."""
    if not text.isascii():
        text = text.translate(_TO_ASCII)
    if any("a" <= c <= "z" for c in text):
        for name, number in MONTHS:
            text = text.replace(name, number)
    seps = "".join(c for c in text if c not in "0123456789")
    for c in "-/.":
        text = text.replace(c, " ")
    values = _values(text.split(" "), seps)
    if values is None or sum(big for _, big in values) > 1:
        return None
    year, month, day = _assigned(values)
    if year is None:
        year = reference.year
    elif year < 100 and not any(big for _, big in values):
        year += reference.year // 100 * 100
        if year >= reference.year + 50:
            year -= 100
        elif year < reference.year - 50:
            year += 100
    month = reference.month if month is None else month
    if not (1 <= year <= 9999 and 1 <= month <= 12):
        return None
    leap = (year % 4 == 0 and year % 100 != 0) or year % 400 == 0
    last = (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]
    day = min(reference.day, last) if day is None else day
    return (year, month, day) if 1 <= day <= last else None


@dataclass
class Spans:
    """Spans of some texts: number of the text, places in the bytes of all texts and in the
    code points of the own one, and what else ``SPAN`` has."""

    row: np.ndarray
    from_byte: np.ndarray
    to_byte: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rank: np.ndarray
    seq: np.ndarray
    entity: np.ndarray
    text: np.ndarray

    def take(self, at: np.ndarray) -> Spans:
        return Spans(*(getattr(self, name)[at] for name in self.__dataclass_fields__))


def _empty() -> Spans:
    return Spans(*(np.empty(0, "i8"),) * 8, np.empty(0, object))


def _found(texts: pa.Array, entities: tuple[str, ...], reference: dt.date) -> Spans:
    """All spans in order of text, finder and place. No text is null."""
    data, at = _bytes(texts)
    # Every match has a digit or an @; most texts have neither, and those are not searched.
    seen = _runs(_NEEDED[data])[at]
    rows = np.flatnonzero(seen[1:] > seen[:-1])
    part = texts.take(pa.array(rows))
    part_data, part_at = _bytes(part) if len(rows) else (data[:0], np.zeros(1, "i8"))
    ascii_only = not len(part_data) or part_data.max() < 0x80
    forms = P.RE2_ASCII if ascii_only else P.RE2
    chars = None if ascii_only else _runs((part_data & 0xC0) != 0x80)
    mark, whole = _mark(part_data), part_data.tobytes()
    if ascii_only:
        whole = whole.decode()
    columns = []
    for number, entity in enumerate(entities):
        if not len(rows):
            break
        a, b = _matches(part, forms[entity], mark)
        if entity == "zipcode":
            # The characters around the digits belong to the match but not to the span.
            first = part_data[a]
            a = a + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            b = a + 5
        found = [whole[i:j] for i, j in zip(a.tolist(), b.tolist())]
        if not ascii_only:
            found = [t.decode() for t in found]
        if entity in ("date", "age"):
            found = [t.lower() for t in found]
        if entity == "date":
            dates = {t for t in set(found) if read_date(t, reference) is not None}
            valid = np.flatnonzero([t in dates for t in found])
            a, b, found = a[valid], b[valid], [found[i] for i in valid.tolist()]
        row = np.searchsorted(part_at, a, "right") - 1
        seq = np.arange(len(row)) - np.searchsorted(row, row)
        own = part_at[row]
        start, end = (a - own, b - own) if chars is None else (chars[a] - chars[own], chars[b] - chars[own])
        moved = at[rows[row]] - own
        text = np.empty(len(found), object)
        text[:] = found
        rank, which = (np.full(len(row), x) for x in (PATTERN_RANK[entity], number))
        columns.append((rows[row], a + moved, b + moved, start, end, rank, seq, which, text))
    if not columns:
        return _empty()
    spans = Spans(*map(np.concatenate, zip(*columns)))
    return spans.take(np.argsort(spans.row, kind="stable"))


def _kept(spans: Spans) -> Spans:
    """The spans that ``resolve`` keeps, in order."""
    order = np.lexsort((spans.seq, spans.rank, spans.end, spans.start, spans.row))
    kept, row, last = [], -1, 0
    columns = (x[order].tolist() for x in (spans.row, spans.start, spans.end))
    for i, r, start, end in zip(order.tolist(), *columns):
        if r != row or start > last:
            kept.append(i)
            row, last = r, end
    return spans.take(np.array(kept, "i8"))


def _lists(spans: Spans, entities: tuple[str, ...], n: int) -> pa.Array:
    labels = pa.array([OUTPUT_LABEL[e] for e in entities], pa.string())
    ints = {c: pa.array(getattr(spans, c).astype("i4")) for c in ("start", "end", "rank", "seq")}
    columns = {
        **ints,
        "entity_type": labels.take(pa.array(spans.entity)),
        "text": pa.array(spans.text, pa.string()),
        "model": pa.array(["regex"], pa.string()).take(pa.array(np.zeros(len(spans.row), "i8"))),
    }
    rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    ends = _runs(np.bincount(spans.row, minlength=n))
    return pa.ListArray.from_arrays(pa.array(ends.astype("i4")), rows)


@dataclass(frozen=True)
class Mask:
    """How spans are replaced, as in ``functions.mask``."""

    mode: str
    special_character: str
    date_level: str
    reference_date: dt.date

    def token(self, entity: str, length: int) -> str:
        if self.mode == "anon":
            return self.special_character * 3
        if self.mode == "anon_l":
            return self.special_character * length
        tag = f"<{OUTPUT_LABEL[entity]}>"
        if self.mode == "tag":
            return tag
        return tag + self.special_character * (length - len(tag))

    def shown(self, text: str) -> str:
        year, month, _ = read_date(text, self.reference_date)
        return str(year) if self.date_level == "year" else f"{month}-{year}"


def _masked(texts: pa.Array, kept: Spans, entities: tuple[str, ...], mask: Mask) -> pa.Array:
    data, at = _bytes(texts)
    whole = data.tobytes()
    keys = list(zip(kept.entity.tolist(), (kept.end - kept.start).tolist()))
    tokens = {k: mask.token(entities[k[0]], k[1]).encode() for k in set(keys)}
    new = [tokens[k] for k in keys]
    if mask.date_level != "hide" and "date" in entities:
        dates = np.flatnonzero(kept.entity == entities.index("date"))
        texts_of = kept.text[dates].tolist()
        shown = {t: mask.shown(t).encode() for t in set(texts_of)}
        for i, t in zip(dates.tolist(), texts_of):
            new[i] = shown[t]
    starts, ends = kept.from_byte.tolist(), kept.to_byte.tolist()
    pieces = [b""] * (2 * len(new) + 1)
    pieces[::2] = [whole[i:j] for i, j in zip([0, *ends], [*starts, len(whole)])]
    pieces[1::2] = new
    grown = np.fromiter(map(len, new), "i8", len(new)) - (kept.to_byte - kept.from_byte)
    to = at + _runs(np.bincount(kept.row, grown, len(texts)))
    buffers = [None, pa.py_buffer(to.astype("i4").tobytes()), pa.py_buffer(b"".join(pieces))]
    return pa.Array.from_buffers(pa.string(), len(texts), buffers)


def _parts(texts: pa.Array):
    """A few texts at a time, so that little more than the result is held."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="i8")
    cuts = np.flatnonzero(np.diff(size // PART)) + 1
    edges = [0, *cuts.tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def pattern_spans(text: Column, entities: list[str], reference: dt.date, merge: bool) -> Column:
    """Spans of the given entities in one array, or with ``merge`` those resolution keeps."""
    names = tuple(entities)

    @F.arrow_udf(f"array<{SPAN}>")
    def search(texts: pa.Array) -> pa.Array:
        out = [_lists(_empty(), names, 0)]
        for part in _parts(texts):
            found = _found(pc.fill_null(part, ""), names, reference)
            out.append(_lists(_kept(found) if merge else found, names, len(part)))
        return pa.concat_arrays(out)

    return search(text)


def masked(text: Column, config: DeidConfig, merge: bool) -> Column:
    """A text masked by the patterns of ``config``, and the found or kept spans."""
    check_mode(config.mode)
    check_date_level(config.date_level)
    names, reference = tuple(config.pattern_entities), config.reference_date
    mask = Mask(config.mode, config.special_character, config.date_level, reference)

    @F.arrow_udf(MASKED)
    def work(texts: pa.Array) -> pa.Array:
        shown, spans = [pa.array([], pa.string())], [_lists(_empty(), names, 0)]
        for part in _parts(texts):
            full = pc.fill_null(part, "")
            found = _found(full, names, reference)
            kept = _kept(found)
            covered = _masked(full, kept, names, mask)
            if part.null_count:
                covered = pc.if_else(pc.is_null(part), pa.scalar(None, pa.string()), covered)
            shown.append(covered)
            spans.append(_lists(kept if merge else found, names, len(part)))
        columns = [pa.concat_arrays(shown), pa.concat_arrays(spans)]
        return pa.StructArray.from_arrays(columns, ["masked_text", "spans"])

    return work(text)
