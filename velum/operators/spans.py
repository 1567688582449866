"""Operators on flat span tables: one row per span, keyed by ``doc_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.arrays import let, rows, running
from velum.functions.finders import SPAN
from velum.functions.resolve import places

SPAN_COLUMNS = ("start", "end", "rank", "seq", "entity_type", "text", "model")

# Positions per tile: spans of a document are resolved tile by tile.
TILE_BITS = 12


def as_struct(prefix: str = "") -> Column:
    """The columns of a flat span row as one span struct."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in SPAN_COLUMNS]).cast(SPAN)


def flatten(df: DataFrame, spans: str) -> DataFrame:
    """One row per element of the span array ``spans``."""
    return df.selectExpr("doc_id", rows(spans))


def first_per_start(spans: DataFrame) -> DataFrame:
    """The first span, in resolution order, at each start of a document.

    No other span with that start can be kept, so this loses nothing, and it bounds
    what is left of a document by the length of its text however many copies there
    are. It combines before the shuffle and its key splits large documents."""
    return (
        spans.groupBy("doc_id", "start")
        .agg(F.min(as_struct()).alias("span"))
        .select("doc_id", "span")
    )


def resolve_spans(spans: DataFrame, touching: str = "drop") -> DataFrame:
    """Greedy overlap resolution of a span table.

    A document is cut into tiles of ``2 ** TILE_BITS`` positions, dealt out one by one.
    What earlier tiles mean to a tile is the place from which on it is free, and that is
    its own start or lies right behind a span that reaches into it. So each tile tells
    for each such place from where on later tiles are free. Only these pairs are gathered by
    document, one for a tile and one for a span over a border, and followed from tile to
    tile; then the tiles are walked from the places found. A span must not end before
    it starts.

    Spans are moved once: equal ones combine ahead of that, a tile goes on with the first span
    at each start, and is found in place when the place is known. The document is a struct,
    since an identifier may be null and structs of nulls are equal."""
    key, behind = places(touching)
    first_tile, next_tile = f"shiftright(span.start, {TILE_BITS})", _tile(behind("span"))
    tiles = (
        spans.select(F.struct("doc_id").alias("document"), as_struct().alias("span"))
        .selectExpr(
            "document",
            rows(
                f"array(named_struct('tile', cast({first_tile} AS long), 'item', named_struct('span', "
                f"span, 'place', cast(NULL AS long))), CASE WHEN {next_tile} > {first_tile} THEN "
                f"named_struct('tile', {next_tile}, 'item', named_struct('span', "
                f"cast(NULL AS {SPAN}), 'place', {behind('span')})) END)"
            ),
        )
        .filter("tile IS NOT NULL")
        .groupBy("document", "tile")
        .agg(F.collect_set("item").alias("items"))
        .selectExpr(
            "document",
            "tile",
            f"{_first_per_start('sort_array(array_compact(items.span))', touching)} AS spans",
            f"array_distinct(concat(array({_first('tile')}), "
            "array_compact(items.place))) AS places",
        )
    )

    def after(free, x):
        return f"CASE WHEN {key(x)} >= {free} THEN {behind(x)} ELSE {free} END"

    passed = (
        "transform(places, p -> named_struct('place', p, "
        f"'free', aggregate(spans, p, (free, x) -> {after('free', 'x')})))"
    )
    followed = (
        tiles.selectExpr("document", f"named_struct('tile', tile, 'passed', {passed}) AS tile")
        .groupBy("document")
        .agg(F.array_sort(F.collect_list("tile")).alias("tiles"))
        .selectExpr("document AS of_document", rows(_entries("tiles")))
    )
    entered = tiles.join(
        followed,
        (tiles["document"] == followed["of_document"]) & (tiles["tile"] == followed["of_tile"]),
    ).select("document.doc_id", "spans", "place")
    kept = running(
        "spans",
        "place",
        after,
        None,
        SPAN,
        lambda free, x: f"{key(x)} >= {free}",
    )
    return flatten(entered, kept)


def _first_per_start(spans: str, touching: str) -> str:
    """The first span at each start; no other one can be kept. An empty span and a longer one
    may both stay when touching spans do."""
    same = "x.start <=> items[i - 1].start"
    if touching == "keep":
        same += " AND (x.start = x.`end`) <=> (items[i - 1].start = items[i - 1].`end`)"
    return let("items", spans, f"filter(items, (x, i) -> i = 0 OR NOT ({same}))")


def _tile(place: str) -> str:
    return f"shiftright({place}, {TILE_BITS + 1})"


def _first(tile: str) -> str:
    return f"shiftleft({tile}, {TILE_BITS + 1})"


def _entries(tiles: str) -> str:
    """The place from which on each tile that is not all covered is free."""

    def inside(free, t):
        return f"{_tile(free)} <= {t}.tile"

    def place(free, t):
        return f"greatest({free}, {_first(f'{t}.tile')})"

    return running(
        tiles,
        "cast(0 AS long)",
        lambda free, t: (
            f"CASE WHEN {inside(free, t)} THEN "
            f"filter({t}.passed, f -> f.place = {place(free, t)})[0].free ELSE {free} END"
        ),
        lambda free, t, _: f"named_struct('of_tile', {t}.tile, 'place', {place(free, t)})",
        "struct<of_tile:bigint,place:bigint>",
        inside,
    )


def distinct_per_document(spans: DataFrame) -> DataFrame:
    """Per document, an array with all its different spans. Copies combine before the
    shuffle."""
    return (
        spans.select("doc_id", as_struct().alias("span"))
        .distinct()
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list("span")).alias("candidates"))
    )


def starts_per_document(spans: DataFrame) -> DataFrame:
    """Per document, an array with all spans that resolution may still keep. Starts must
    lie inside the text, which bounds the array by its length."""
    return (
        first_per_start(spans).groupBy("doc_id").agg(F.collect_list("span").alias("candidates"))
    )


def span_text(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Attach to each span the text it covers. The join is on the document alone;
    adaptive execution splits a document with very many spans."""
    covered = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return (
        spans.drop("text")
        .join(documents.select("doc_id", "text"), "doc_id")
        .withColumn("text", covered)
    )
