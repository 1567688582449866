"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits. Numbers, capitalised words and units behind numbers
become typed placeholders; what is left, in lower case, is the template. Windows of a
document's template are joined by hash with those of the benchmark, so a question whose
names and figures were exchanged still meets its original. Then the slots are compared: on
one alignment of document and item each value of the item must always stand for the same
value of the document. In the same join each window also goes by its values in lower case,
whatever they are, so a copy is found in any case of letters and however few of its tokens
are literal.

A table of 2^24 bits made from the benchmark's hashes lets nearly all windows of a
document go before they leave the task; its size is fixed, and what passes is joined
exactly by Spark, however large the benchmark is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import BYTES, LOWER, Stretches, buffer, pieces, runs, windows
from velum.llm.shared import Scratch, col

WINDOW = 12
LITERALS = 0.4
# Literal tokens from which the only template of an item is enough by itself.
ALONE = 5
SIEVE_BITS = 24
# Units of measure and money.
UNITS = (
    "mm cm m km in ft yd mi miles mile meters metres meter metre feet inches kg g mg lb lbs oz "
    "grams gram kilograms pounds tons l ml liters litres gallons s sec seconds min minutes h "
    "hours hour days day weeks week months years percent usd eur dollars dollar cents euros "
    "degrees mph kmh w kw v hz mb gb"
).split()
NUM, NAME, UNIT = (np.uint64(n) for n in (1, 2, 3))
# Keeps hashes of values apart from those of templates.
VALUES = np.uint64(0xA0761D6478BD642F)

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
POINT = np.zeros(256, bool)
POINT[[44, 46]] = True


def _units() -> np.ndarray:
    data, at = buffer(pa.array(UNITS))
    return np.sort(Stretches(LOWER[data])(at[:-1], at[1:]))


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = LETTER[data]
    if len(data) > 2:
        # A point or comma between digits belongs to the number.
        inner = POINT[data[1:-1]] & DIGIT[data[:-2]] & DIGIT[data[2:]]
        inside[1:-1] |= inner
    return runs(inside, at)


def _lower(texts, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the tokens in lower case. Lower case maps letters to letters, so the
    tokens stay the same ones; bytes that are no UTF-8 are lowered as ASCII."""
    if (data > 127).any():
        try:
            data, at = buffer(pc.utf8_lower(texts))
            start, end = _tokens(data, at)
        except pa.ArrowInvalid:
            pass
    return Stretches(LOWER[data])(start, end)


class Template:
    """Tokens of some texts: template codes, exact values, and which ones are slots."""

    def __init__(self, texts):
        data, at = buffer(texts)
        start, end = _tokens(data, at)
        self.first = np.searchsorted(start, at)
        low = _lower(texts, data, start, end)
        head = data[start]
        second = data[np.minimum(start + 1, len(data) - 1)] if len(data) else head
        number = DIGIT[head]
        capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        behind = np.concatenate(([False], number[:-1])) if len(number) else number
        behind[self.first[:-1][self.first[:-1] < len(behind)]] = False
        unit = behind & np.isin(low, _units())
        self.code = np.where(number, NUM, np.where(unit, UNIT, np.where(capital, NAME, low)))
        self.slot = number | unit | capital
        self.value = low

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of templates in which enough tokens are literal."""
        place, found = windows(self.code, self.first, n)
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        enough = n - (slots[place + n] - slots[place]) >= LITERALS * n
        return place[enough], found[enough]

    def exact(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows and hashes of their values."""
        place, found = windows(self.value, self.first, n)
        return place, found ^ VALUES


ROWS = "row long, n int, h long, place int, slots array<long>"
ITEM_ROWS = f"{ROWS}, alone boolean"


def _exact_rows(found: Template, place, n: int, h, rows: np.ndarray) -> pa.RecordBatch:
    """Windows by their values have no slots (null)."""
    owner = np.searchsorted(found.first, place, "right") - 1
    return pa.RecordBatch.from_pydict(
        {
            "row": rows[owner],
            "n": np.full(len(place), n, "i4"),
            "h": h.view("i8"),
            "place": (place - found.first[owner]).astype("i4"),
            "slots": pa.nulls(len(place), pa.list_(pa.int64())),
        }
    )


def _window_rows(found: Template, place, n: int, h, rows: np.ndarray) -> pa.RecordBatch:
    owner = np.searchsorted(found.first, place, "right") - 1
    index = place[:, None] + np.arange(n)
    slot = found.slot[index]
    values = found.value[index][slot].view("i8")
    ends = np.concatenate(([0], np.cumsum(slot.sum(1)))).astype("i4")
    return pa.RecordBatch.from_pydict(
        {
            "row": rows[owner],
            "n": np.full(len(place), n, "i4"),
            "h": h.view("i8"),
            "place": (place - found.first[owner]).astype("i4"),
            "slots": pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
        }
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of benchmark items (``row`` and ``text``): all of ``window`` tokens, and
    for shorter items the item as one. ``alone`` is a template that is its item's only
    one and has enough literal tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found, rows = Template(piece.column("text")), np.asarray(piece.column("row"))
                sizes = np.diff(found.first)
                for n in (window, *np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist()):
                    for cut_out, as_rows in ((found.windows, _window_rows), (found.exact, _exact_rows)):
                        place, h = cut_out(n)
                        owner = np.searchsorted(found.first, place, "right") - 1
                        whole = (sizes[owner] == n) | (n == window)
                        if whole.any():
                            out = as_rows(found, place[whole], n, h[whole], rows)
                            only = np.bincount(owner[whole], minlength=len(rows))[owner[whole]] == 1
                            slots = pc.fill_null(pc.list_value_length(out["slots"]), n).to_numpy()
                            yield out.append_column("alone", pa.array(only & (n - slots >= ALONE)))

    return items.select("row", "text").mapInArrow(cut, ITEM_ROWS)


def document_windows(docs: DataFrame, sieve: np.ndarray, lengths: list[int]) -> DataFrame:
    """Windows of documents whose hash may be one of the benchmark's."""
    shipped = docs.sparkSession.sparkContext.broadcast(sieve)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            for piece in pieces(batch):
                found, rows = Template(piece.column("text")), np.asarray(piece.column("row"))
                for n in lengths:
                    for cut_out, as_rows in ((found.windows, _window_rows), (found.exact, _exact_rows)):
                        place, h = cut_out(n)
                        key = h >> np.uint64(64 - SIEVE_BITS)
                        hit = (bits[key >> np.uint64(3)] >> (key & np.uint64(7)).astype("u1")) & 1 > 0
                        if hit.any():
                            yield as_rows(found, place[hit], n, h[hit], rows)

    return docs.select("row", "text").mapInArrow(cut, ROWS)


def _sieve(found: DataFrame) -> np.ndarray:
    keys = found.select(F.shiftrightunsigned("h", 64 - SIEVE_BITS).alias("k")).distinct()
    keys = keys.toArrow()["k"].to_numpy()
    bits = np.zeros(1 << (SIEVE_BITS - 3), "u1")
    np.bitwise_or.at(bits, keys >> 3, (1 << (keys & 7)).astype("u1"))
    return bits


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", window: int = WINDOW,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``first, item, item_id, n_windows, exact``: documents that hold (part of) an item, both
    by the hash of identifier and text (``first``, ``item``), with the matching windows of
    their best alignment and whether a window has the item's own values; and ``row, first``:
    all documents with windows of items, and for each the one whose windows are the same.
    Items may have identifiers of any type, equal ones or none; equal items count as one.

    An alignment counts if one of its windows is exact, in any case of letters, or if it
    has two templates, or the only one of the item with ``ALONE`` literal tokens, and all
    its slots are consistent. Texts and items that are null or without words match
    nothing."""
    scratch = scratch or Scratch(docs.sparkSession)
    items = benchmark.select(
        row_key(benchmark, item_text, item_id).alias("row"),
        col(item_id).alias("item_id"), col(item_text).alias("text"),
    ).dropDuplicates(["row"])
    # Under names of its own, so that the identifiers meet the windows whatever their type.
    names = items.select(F.col("row").alias("item"), "item_id")
    cut = item_windows(items, window).withColumnRenamed("row", "item")
    items = scratch.keep(cut.join(names, "item"), "items")
    lengths = [r[0] for r in items.select("n").distinct().collect()]
    rows = docs.select(row_key(docs, text, doc_id).alias("row"), col(text).alias("text"))
    found = scratch.keep(document_windows(rows, _sieve(items), lengths), "windows")
    # What passes the sieve by chance would tell documents apart.
    found = found.join(items.select("n", "h").distinct(), ["n", "h"], "left_semi").distinct()
    found, members = _alike(scratch.keep(found, "found"), scratch)
    met = found.alias("d").join(items.alias("b"), ["n", "h"])
    met = scratch.keep(
        met.select(
            F.col("d.row").alias("row"), F.col("b.item").alias("item"), "item_id",
            (F.col("d.place") - F.col("b.place")).alias("shift"),
            F.col("d.place").alias("place"),
            F.col("d.slots").alias("ours"), F.col("b.slots").alias("theirs"), "alone",
        ),
        "met",
    )
    key = ("row", "item", "shift")
    slots = (
        met.select(*key, F.explode(F.arrays_zip("theirs", "ours")).alias("s"))
        .groupBy(*key, "s.theirs")
        .agg((F.min("s.ours") == F.max("s.ours")).alias("same"))
        .groupBy(*key)
        .agg(F.every("same").alias("consistent"))
    )
    aligned = met.groupBy(*key).agg(
        F.first("item_id").alias("item_id"),
        F.countDistinct("place").alias("n_windows"),
        F.countDistinct(F.when(F.isnotnull("theirs"), F.col("place"))).alias("n_templates"),
        F.some("alone").alias("alone"),
        F.some(F.isnull("theirs") | (F.col("ours") == F.col("theirs"))).alias("exact"),
    )
    held = (
        aligned.join(slots, list(key), "left")
        .filter("exact OR ((n_templates > 1 OR alone) AND coalesce(consistent, true))")
        .groupBy("row", "item")
        .agg(
            F.first("item_id").alias("item_id"),
            F.max("n_windows").alias("n_windows"),
            F.max("exact").alias("exact"),
        )
    )
    return held.withColumnRenamed("row", "first"), members


def _alike(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Windows of one document for each pattern, and ``row, first``: the documents with the
    one that stands for them.

    Documents with the same windows, slots and distances between them meet the same items in
    the same way. So a phrase that many documents share meets the items that have it once,
    however many these are."""
    base = found.groupBy("row").agg(F.min("place").alias("base"))
    # A hash passes over nulls and empty lists alike, so it is told which of them slots are.
    window = ("n", "h", "slots", F.isnull("slots"), F.col("place") - F.col("base"))
    marks = found.join(base, "row").select(
        "row", F.xxhash64(*window).alias("a"), F.xxhash64(F.lit(1), *window).alias("b")
    )
    pattern = marks.groupBy("row").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("c")
    )
    pattern = scratch.keep(pattern, "patterns")
    first = pattern.groupBy("a", "b", "c").agg(F.min("row").alias("first"))
    members = scratch.keep(pattern.join(first, ["a", "b", "c"]).select("row", "first"), "members")
    return found.join(members.filter("row = first").select("row"), "row", "left_semi"), members


def row_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id"):
    """Identifier and text of a row as one hash; equal rows share it."""
    return F.xxhash64(col(doc_id), F.coalesce(col(text), F.lit("")))


def _verdicts(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    held, members = contamination(docs, benchmark, **columns)
    verdicts = held.groupBy("first").agg(
        F.count("*").alias("n_items"),
        F.min("item_id").alias("item_id"),
        F.max("n_windows").alias("n_windows"),
        F.max("exact").alias("exact"),
    )
    return members.join(verdicts, "first").drop("first")


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **columns) -> DataFrame:
    """``doc_id, contaminated, n_items, item_id, n_windows, exact`` for every row of
    ``docs``; without a match the counts are 0 and the rest null or false."""
    found = _verdicts(docs, benchmark, text=text, doc_id=doc_id, **columns)
    rows = docs.select(col(doc_id).alias("doc_id"), row_key(docs, text, doc_id).alias("row"))
    return rows.join(found, "row", "left").select(
        "doc_id",
        F.isnotnull("n_items").alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("exact", F.lit(False)).alias("exact"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **columns) -> DataFrame:
    """Rows of ``docs`` without contaminated documents."""
    found = _verdicts(docs, benchmark, text=text, doc_id=doc_id, **columns)
    marked = docs.withColumn("_row", row_key(docs, text, doc_id))
    return marked.join(found.select(F.col("row").alias("_row")), "_row", "left_anti").drop("_row")
