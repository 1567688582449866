"""Substring dedup on bytes with suffix arrays.

Any 400 bytes are routed by their minimizer, the least hash among their 24-byte pieces:
equal strings have the same one at the same place, so what has no minimizer in common is
never compared. Neighbouring strings with one minimizer form a run; a document is cut into
runs of some 190 strings. Runs are counted by minimizer and content, 8 bytes each. Where a
minimizer has several runs, one text per distinct content is fetched, with the number of
its copies, and tasks sort their suffixes in two stages (``suffixes``); neighbours with a
common prefix of 400 bytes are repeated strings.

Exact copies, however many, are one content. A minimizer with more distinct contents than
``MOST_BYTES`` would not fit one task: its strings are counted one by one instead, by
their hash, spread over the cluster."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import BYTES, Stretches, buffer, pieces, within
from velum.llm.shared import Scratch, col
from velum.llm.suffixes import DEPTH, Parts

LENGTH = DEPTH
GRAM = 24
BLOCK_BYTES = 12 << 20
SORT_BYTES = 3 << 20
MOST_BYTES = 16 << 20

RUNS = "block long, key long, start int, n int, h long, piece long"
TEXTS = "h long, piece long, m long, text binary"
CODES = "h long, piece long, m long, at int, code long"
SPANS = "h long, piece long, spans array<int>"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, from blocks of that width."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo("u8").max, "u8")
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def minimizer_runs(texts, length: int = LENGTH, gram: int = GRAM):
    """Runs of strings with one minimizer: the text each is in, the place of its first
    string there, the number of strings, the minimizer's hash and that of the bytes."""
    data, at = buffer(texts)
    place = within(at, length) if len(data) >= length else np.empty(0, "i8")
    if not len(place):
        return (np.empty(0, "i8"),) * 3 + (np.empty(0, "u8"),) * 2
    sums = Stretches(BYTES[data])
    grams = np.arange(len(data) - gram + 1)
    h = sums(grams, grams + gram)
    # The upper half of the hash decides, then the place: the same in equal strings.
    low = np.uint64(0xFFFFFFFF)
    least = _least((h & ~low) | grams.astype("u8"), length - gram + 1)[place] & low
    owner = np.searchsorted(at, place, "right") - 1
    new = np.ones(len(place), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(place)])))
    start = place[first]
    piece = sums(start, start + n + length - 1)
    return owner[first], start - at[owner[first]], n, h[least[first]], piece


def _runs(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                owner, start, n, h, piece = minimizer_runs(part.column("text"))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": np.asarray(part.column("block"))[owner],
                        "key": np.asarray(part.column("key"))[owner],
                        "start": start.astype("i4"),
                        "n": n.astype("i4"),
                        "h": h.view("i8"),
                        "piece": piece.view("i8"),
                    }
                )

    return docs.select("block", "key", "text").mapInArrow(cut, RUNS)


def _picked(left, right):
    """The bytes of a block's texts, where the rows of ``right`` start in them, and the
    first of the texts equal to each."""
    data, at = buffer(left["text"])
    keys = np.asarray(left["key"])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    found = order[np.searchsorted(keys, np.asarray(right["key"]))]
    equal = np.empty(len(keys), "i8")
    equal[order] = order[np.searchsorted(keys, keys)]
    return data, at, at[found] + np.asarray(right["start"]), equal


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs."""

    def fetch(left, right):
        data, _, start, _ = _picked(left, right)
        end = start + np.asarray(right["n"]) + LENGTH - 1
        texts = pa.array([data[a:b].tobytes() for a, b in zip(start, end)], pa.binary())
        return right.select(["h", "piece", "m"]).append_column("text", texts)

    both = docs.groupBy("block").cogroup(wanted.groupBy("block"))
    return both.applyInArrow(fetch, TEXTS)


def _sorted_spans(texts: DataFrame) -> DataFrame:
    """Repeated strings of the fetched runs, as places [from, to) among a run's strings.
    All runs of a minimizer are in one batch."""

    def repeated(table: pa.Table) -> pa.RecordBatch:
        parts = Parts(table["text"].to_pylist())
        order = parts.order()
        classes = parts.classes(order)
        owner = np.searchsorted(parts.at, order, "right") - 1
        times = np.asarray(table["m"])[owner]
        hit = order[np.bincount(classes, times)[classes] > 1] if len(order) else order
        marked = np.zeros(len(parts.data) + 1, bool)
        marked[hit] = True
        edge = np.flatnonzero(marked[1:] != marked[:-1]) + 1
        if marked[0]:
            edge = np.concatenate(([0], edge))
        a, b = edge[::2], edge[1::2]
        owner = np.searchsorted(parts.at, a, "right") - 1
        rows, n = np.unique(owner, return_counts=True)
        flat = np.stack((a - parts.at[owner], b - parts.at[owner]), axis=1).ravel().astype("i4")
        ends = np.concatenate(([0], np.cumsum(2 * n))).astype("i4")
        return pa.RecordBatch.from_pydict(
            {
                "h": np.asarray(table["h"])[rows],
                "piece": np.asarray(table["piece"])[rows],
                "spans": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            }
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            h = np.asarray(table["h"])
            sizes = np.cumsum(np.fromiter(map(len, table["text"].to_pylist()), "i8", len(h)))
            # Cut where a minimizer ends; the last one may go on in the next batch.
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            at = 0
            while len(cuts) and cuts[-1] > at:
                before = sizes[at - 1] if at else 0
                k = np.searchsorted(sizes[cuts - 1], before + SORT_BYTES, "right")
                stop = max(cuts[max(0, k - 1)], cuts[np.searchsorted(cuts, at, "right")])
                yield repeated(table.slice(at, stop - at))
                at = int(stop)
            rest = table.slice(at)
        if rest is not None and rest.num_rows:
            yield repeated(rest)

    dealt = texts.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(work, SPANS)


def _counted_spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for minimizers with too many contents, string by string."""

    def strings(left, right):
        data, _, start, _ = _picked(left, right)
        n = np.asarray(right["n"]).astype("i8")
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = start[row] + at
        code = Stretches(BYTES[data])(place, place + LENGTH) if len(row) else np.empty(0, "u8")
        return right.select(["h", "piece", "m"]).take(row).append_column(
            "at", pa.array(at.astype("i4"))
        ).append_column("code", pa.array(code.view("i8")))

    both = docs.groupBy("block").cogroup(wanted.groupBy("block"))
    codes = both.applyInArrow(strings, CODES)
    often = codes.groupBy("code").agg(F.sum("m").alias("k")).filter("k > 1").select("code")
    places = codes.join(often, "code").groupBy("h", "piece").agg(F.array_sort(F.collect_list("at")).alias("a"))
    spans = F.flatten(F.transform("a", lambda x: F.array(x, x + 1)))
    return places.select("h", "piece", spans.alias("spans"))


def _kept(docs: DataFrame, spans: DataFrame) -> DataFrame:
    def remove(left, right):
        data, at, start, equal = _picked(left, right)
        spans = right["spans"].combine_chunks()
        sizes = np.diff(spans.offsets.to_numpy()) // 2
        flat = spans.flatten().to_numpy().astype("i8")
        start = np.repeat(start, sizes)
        change = np.zeros(len(data) + 1, "i4")
        np.add.at(change, start + flat[::2], 1)
        np.add.at(change, start + flat[1::2] - 1 + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        for row in np.flatnonzero(equal != np.arange(len(equal))):
            same = equal[row]
            gone[at[row] : at[row + 1]] = gone[at[same] : at[same + 1]]
        ends = at[1:][at[1:] > at[:-1]] - 1
        closes = gone.copy()
        closes[:-1] &= ~gone[1:]
        closes[ends] = gone[ends]
        removed = np.concatenate(([0], np.cumsum(gone)))[at]
        runs = np.concatenate(([0], np.cumsum(closes)))[at]
        left_over = [data[a:b][~gone[a:b]] for a, b in zip(at[:-1], at[1:])]
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "n_bytes": pa.array(np.diff(at), pa.int64()),
                "n_removed": pa.array(np.diff(removed), pa.int64()),
                "n_spans": pa.array(np.diff(runs), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in left_over], pa.string()),
            }
        )

    both = docs.groupBy("block").cogroup(spans.groupBy("block"))
    return both.applyInArrow(remove, KEPT)


def dedup_substrings(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``df``.

    A byte of a text's UTF-8 form goes if a string of 400 bytes that covers it also starts
    anywhere else, in the same or another text; strings lie in one text each and are those
    of the input. A null text is empty; identifiers may be null or repeated; texts of fewer
    than 400 bytes keep all. An empty table gives no rows; other columns are not read."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(
        col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key = F.xxhash64("doc_id", "text")
    docs = rows.withColumn("key", key).withColumn(
        "block", F.pmod("key", F.lit(total // BLOCK_BYTES + 1)).cast("long")
    )
    runs = scratch.keep(_runs(docs), "runs")
    contents = runs.groupBy("h", "piece").agg(
        F.count("*").alias("m"), F.first("n").alias("n"),
        F.min(F.struct("block", "key", "start")).alias("place"),
    )
    contents = scratch.keep(contents, "contents")
    groups = contents.groupBy("h").agg(
        F.sum("m").alias("all"), F.sum(F.col("n") + LENGTH).alias("bytes")
    ).filter(F.col("all") > 1)
    groups = scratch.keep(groups.select("h", (F.col("bytes") > MOST_BYTES).alias("large")), "groups")
    wanted = contents.join(groups, "h").select("h", "piece", "m", "n", "large", "place.*")
    wanted = scratch.keep(wanted, "wanted")
    docs_of = docs.select("block", "key", "text")
    small = wanted.filter("NOT large").drop("large")
    texts = scratch.keep(_fetched(docs_of, small), "texts")
    spans = _sorted_spans(texts)
    large = wanted.filter("large").drop("large")
    if not large.isEmpty():
        spans = spans.unionByName(_counted_spans(docs_of, large))
    spans = scratch.keep(spans, "spans")
    scratch.drop("texts", "wanted", "contents")
    placed = runs.join(spans, ["h", "piece"]).select("block", "key", "start", "spans")
    return scratch.keep(_kept(docs.select("block", "key", "doc_id", "text"), placed), "kept")
