"""Array helpers built on higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

# Elements of which the states are folded together.
CHUNK = 32


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once.

    It is the last step of a fold over nothing: a ``transform`` would copy the result, with
    all that is in it, at each ``let`` around it."""
    return f"aggregate(cast(array() AS array<int>), {value}, (kept, none) -> kept, {name} -> {body})"


def literal(text: str) -> str:
    """A string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def literal_map(values: dict) -> str:
    pairs = ", ".join(
        f"{literal(k)}, {literal(v) if isinstance(v, str) else v}" for k, v in values.items()
    )
    return f"map({pairs})"


def section(array: str, first: str, last: str) -> str:
    """Elements ``first`` to ``last``, from 0. Unlike ``slice`` this does not copy the
    whole array to take a part of it."""
    return f"transform(sequence({first}, {last}), at -> get({array}, at))"


def rows(array: str) -> str:
    """Generator of one row per struct in an array column.

    For a bare column the optimizer adds the filter ``size(column) > 0`` and pushes
    it below the projection that computes the column, and below a repartition, so
    that the whole expression is evaluated twice more. It does not for a call."""
    return f"inline(array_compact({array}))"


def empty(element: str) -> str:
    return f"cast(array() AS array<{element}>)"


def running(
    items: str,
    zero: str,
    advance: Callable[[str, str], str],
    emit: Callable[[str, str, str], str] | None,
    element: str,
    where: Callable[[str, str], str] | None = None,
) -> str:
    """Walk ``items`` in order with a running state and gather what is emitted.

    ``advance(state, item)`` gives the next state, ``emit(state, item, i)`` the output for
    item number ``i`` under the state before it, which is given where ``where(state, item)``
    holds. Without ``emit`` the items themselves are given. ``element`` is the output element
    type.

    Folds copy what they hold, with all that is in it, at each step. So only states are
    folded: the state ahead of each chunk first, then those in each chunk; the output is made
    from items and states afterwards."""

    def within(chunk, state, fold):
        last = f"least({chunk} * {CHUNK} + {CHUNK - 1}, size(items) - 1)"
        return f"aggregate(sequence({chunk} * {CHUNK}, {last}), {state}, {fold})"

    item = "get(items, at)"
    gather = f"(acc, at) -> concat(acc, array({advance('element_at(acc, -1)', item)}))"
    ahead = (
        f"aggregate(sequence(0, cast(floor((size(items) - 1) / {CHUNK}) AS int)), array({zero}), "
        "(ahead, c) -> concat(ahead, array("
        f"{within('c', 'element_at(ahead, -1)', f'(acc, at) -> {advance("acc", item)}')})))"
    )
    several = let(
        "ahead",
        ahead,
        f"transform(slice(ahead, 1, size(ahead) - 1), (s, c) -> {within('c', 'array(s)', gather)})",
    )
    states = (
        f"CASE WHEN size(items) <= {CHUNK} THEN array({within('0', f'array({zero})', gather)}) "
        f"ELSE {several} END"
    )
    state = f"get(get(states, cast(floor(i / {CHUNK}) AS int)), i % {CHUNK})"
    if emit is None:
        out = f"filter(items, (item, i) -> {where(state, 'item')})"
    elif where is None:
        out = f"transform(items, (item, i) -> {emit(state, 'item', 'i')})"
    else:
        given = f"CASE WHEN {where(state, 'item')} THEN {emit(state, 'item', 'i')} END"
        out = f"array_compact(transform(items, (item, i) -> {given}))"
    return let(
        "items",
        items,
        f"CASE WHEN size(items) > 0 THEN {let('states', states, out)} ELSE {empty(element)} END",
    )
