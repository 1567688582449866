"""Overlap resolution inside one row."""

from __future__ import annotations

from collections.abc import Callable

from velum.functions.arrays import running
from velum.functions.finders import SPAN


def places(touching: str = "drop") -> tuple[Callable[[str], str], Callable[[str], str]]:
    """The rule of ``resolve`` as two numbers of a span: its place in order, and the first
    place that is free behind it. A span is kept if its place is not before the one that
    the last kept span left free.

    Each position has two places, for an empty span and for a longer one that starts
    there, since both may stay when touching spans do."""
    if touching not in ("drop", "keep"):
        raise ValueError("touching must be 'drop' or 'keep'")

    def place(span):
        return f"(2L * {span}.start + cast({span}.`end` > {span}.start AS long))"

    def behind(span):
        return f"(2L * {span}.`end` + {2 if touching == 'drop' else 1})"

    return place, behind


def resolve(spans: str, touching: str = "drop", element: str = SPAN) -> str:
    """Keep spans greedily in order of (start, end, rank, seq): the first one, then
    each that starts after the end of all kept ones.

    A span that starts exactly where a kept one ends is dropped; with
    ``touching='keep'`` it stays unless it is empty. The struct's leading fields must be
    ``start, end, rank, seq``."""
    if touching not in ("drop", "keep"):
        raise ValueError("touching must be 'drop' or 'keep'")
    def keeps(last_end, span):
        free = f"{last_end} IS NULL OR {span}.start > {last_end}"
        if touching == "keep":
            free += f" OR ({span}.start = {last_end} AND {span}.`end` > {span}.start)"
        return f"({free})"

    return running(
        f"sort_array({spans})",
        "cast(NULL AS int)",
        lambda last, x: f"CASE WHEN {keeps(last, x)} THEN greatest({last}, {x}.`end`) ELSE {last} END",
        None,
        element,
        keeps,
    )
