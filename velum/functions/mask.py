"""Masking a text by its kept spans, inside one row."""

from __future__ import annotations

import datetime as dt

from velum.config import check_date_level, check_mode
from velum.functions.arrays import let, literal, section
from velum.functions.dates import generalise, parse_date

# Code points per block of a long text.
BLOCK = 1024


def token(span: str, mode: str, special_character: str) -> str:
    """What replaces one span."""
    check_mode(mode)
    length = f"({span}.`end` - {span}.start)"
    fill = literal(special_character)
    if mode == "anon":
        return f"repeat({fill}, CASE WHEN {length} > 0 THEN 3 ELSE 0 END)"
    if mode == "anon_l":
        return f"repeat({fill}, {length})"
    tag = f"concat('<', {span}.entity_type, '>')"
    if mode == "tag":
        return tag
    return f"concat({tag}, repeat({fill}, greatest(0, {length} - length({tag}))))"


def mask(
    text: str,
    kept: str,
    mode: str = "tag",
    special_character: str = "*",
    date_level: str = "hide",
    reference_date: dt.date | None = None,
) -> str:
    """Replace ``kept`` spans, which are ordered and free of overlap, in ``text``.

    With a date level other than ``hide``, spans labelled ``DATA`` become a year or
    a month and year in every mode."""
    check_date_level(date_level)
    replacement = token("x", mode, special_character)
    if date_level != "hide":
        if reference_date is None:
            raise ValueError("a date level needs a reference_date")
        shown = let(
            "d",
            parse_date("lower(x.text)", reference_date),
            f"CASE WHEN d IS NOT NULL THEN {generalise('d', date_level)} END",
        )
        replacement = (
            f"CASE WHEN x.entity_type = 'DATA' THEN coalesce({shown}, {replacement}) "
            f"ELSE {replacement} END"
        )

    # A substring counts code points from the start of its string, so the pieces of
    # a long text are cut from the few blocks they lie in. A short text is one block.
    blocks = (
        f"CASE WHEN length({text}) <= {BLOCK} THEN array({text}) "
        f"ELSE regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}', 0) END"
    )

    def piece(start, end):
        first = f"cast(floor({start} / {BLOCK}) AS int)"
        last = f"cast(floor(({end} - 1) / {BLOCK}) AS int)"
        around = (
            f"CASE WHEN {first} = {last} THEN get(blocks, {first}) "
            f"ELSE array_join({section('blocks', first, last)}, '') END"
        )
        return (
            f"CASE WHEN {end} > {start} THEN "
            f"substring(({around}), {start} - {first} * {BLOCK} + 1, {end} - {start}) ELSE '' END"
        )

    before = piece("(CASE WHEN i > 0 THEN get(kept_spans, i - 1).`end` ELSE 0 END)", "x.start")
    after = piece("element_at(kept_spans, -1).`end`", f"length({text})")
    masked = let(
        "blocks",
        blocks,
        f"concat(array_join(transform(kept_spans, (x, i) -> concat({before}, {replacement})), ''), "
        f"{after})",
    )
    return let(
        "kept_spans", kept, f"CASE WHEN size(kept_spans) = 0 THEN {text} ELSE {masked} END"
    )
