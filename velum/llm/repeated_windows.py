"""Substring dedup on words with difference-cover anchors.

A document keeps the words that no repeated window covers. Comparing all windows would
move a hash for each word, so anchors are compared first: stretches of seven words that
start at places 0, 1 or 3 modulo 7. Any two numbers differ by the difference of two of
these, so two equal windows of 13 words, wherever they start, hold an equal anchor at
places that are anchors in both. Windows with a shared anchor are extended to their full
length: only their hashes are compared again, and the smallest document of each decides.

Documents are dealt out to blocks of bounded size. Anchors go from blocks to buckets by
their hash, 4 bytes each and once per block and batch, so a passage that a third of all
documents share is one entry a block; shared ones come back to the blocks that have them.
A bucket holds a bounded number of anchors at any size of the corpus, which bounds the
chance that an anchor is taken for shared by accident; windows are compared by 64 bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import Stretches, Words, pieces, within
from velum.llm.shared import Scratch, col

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 48 << 20
LAST = (1 << 63) - 1

ANCHORS = "bucket long, block long, hashes binary"
SHARED = "block long, bucket long, hashes binary, least binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Anchored:
    """Words of some texts with their anchors: ``place`` of the first word, ``bucket``
    and ``code`` of the hash."""

    def __init__(self, texts, buckets: int, window: int):
        self.words = words = Words(texts)
        self.sums = Stretches(words.hash)
        size = window - PERIOD + 1
        place = within(words.first, size)
        owner = np.searchsorted(words.first, place, "right") - 1
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        self.place = place = place[cover[(place - words.first[owner]) % PERIOD]]
        h = self.sums(place, place + size)
        self.bucket, self.code = h % np.uint64(buckets), (h >> np.uint64(32)).astype("u4")
        self.window = window

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows that hold a shared anchor."""
        words, n = self.words, len(self.words.hash)
        key = self.bucket << np.uint64(32) | self.code
        at = np.searchsorted(shared, key)
        at[at == len(shared)] = 0
        hit = self.place[shared[at] == key] if len(shared) else self.place[:0]
        change = np.zeros(n + 1, "i4")
        np.add.at(change, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(change, hit + 1, -1)
        place = within(words.first, self.window)
        place = place[np.cumsum(change[:n])[place] > 0]
        return place, self.sums(place, place + self.window)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length at the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.concatenate((np.flatnonzero(new), [n]))


def _anchors(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in pieces(batch):
                found = Anchored(piece.column("text"), buckets, window)
                owner = np.searchsorted(found.words.first, found.place, "right") - 1
                block = np.asarray(piece.column("block"))[owner].astype("u8")
                parts.append((block * np.uint64(buckets) + found.bucket, found.code))
            group = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, "u8")
            code = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, "u4")
            if not len(group):
                continue
            if group.max() < 1 << 32:
                packed = np.sort(group << np.uint64(32) | code)
                group, code = packed >> np.uint64(32), packed.astype("u4")
            else:
                order = np.lexsort((code, group))
                group, code = group[order], code[order]
            # An anchor that a batch has twice is sent twice: that alone makes it shared.
            runs = _groups(group, code)
            sizes = np.minimum(np.diff(runs), 2)
            group, code = np.repeat(group[runs[:-1]], sizes), np.repeat(code[runs[:-1]], sizes)
            ends = _groups(group)
            first = group[ends[:-1]]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": (first % np.uint64(buckets)).astype("i8"),
                    "block": (first // np.uint64(buckets)).astype("i8"),
                    "hashes": [code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])],
                }
            )

    return docs.select("block", "text").mapInArrow(cut, ANCHORS)


def _unpacked(table: pa.Table, kind: str, name: str = "hashes") -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column, and the number of the row each comes from."""
    rows = [np.frombuffer(b, kind) for b in table[name].to_pylist()]
    sizes = [len(r) for r in rows]
    return (np.concatenate(rows) if rows else np.empty(0, kind)), np.repeat(np.arange(len(rows)), sizes)


def _shared_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors that occur more than once, for each block that has them."""

    def meet(key, table):
        code, row = _unpacked(table, "u4")
        order = np.argsort(code)
        code, block = code[order], np.asarray(table["block"])[row[order]]
        runs = _groups(code)
        often = np.repeat(np.diff(runs) > 1, np.diff(runs))
        code, block = code[often], block[often]
        order = np.lexsort((code, block))
        code, block = code[order], block[order]
        runs = _groups(block, code)[:-1]
        code, block = code[runs], block[runs]
        ends = _groups(block)
        n = len(ends) - 1 if len(block) else 0
        return pa.table(
            {
                "block": pa.array(block[ends[:-1]] if n else [], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * n, pa.int64()),
                "hashes": pa.array([code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])][:n], pa.binary()),
                "least": pa.nulls(n, pa.binary()),
            }
        )

    return anchors.groupBy("bucket").applyInArrow(meet, SHARED)


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what came back to a block: shared anchors, and windows with their least document."""
    anchor, window = table.filter(pc.is_null(table["least"])), table.filter(pc.is_valid(table["least"]))
    code, row = _unpacked(anchor, "u4")
    shared = np.asarray(anchor["bucket"])[row].astype("u8") << np.uint64(32) | code if len(code) else np.empty(0, "u8")
    h, _ = _unpacked(window, "u8")
    least, _ = _unpacked(window, "i8", "least")
    order = np.argsort(h)
    return np.sort(shared), h[order], least[order]


def _windows(docs: DataFrame, shared: DataFrame, buckets: int, window: int) -> DataFrame:
    """Candidate windows of each block with the least document that has them there."""

    def extend(key, left, right):
        known, _, _ = _known(right)
        hs, ids = [np.empty(0, "u8")], [np.empty(0, "i8")]
        for piece in pieces(left):
            found = Anchored(piece["text"], buckets, window)
            place, h = found.candidates(known)
            owner = np.searchsorted(found.words.first, place, "right") - 1
            hs.append(h)
            ids.append(np.asarray(piece["doc_id"])[owner])
        h, ids = np.concatenate(hs), np.concatenate(ids)
        order = np.argsort(h)
        h, ids = h[order], ids[order]
        runs = _groups(h)
        if len(h):
            ids, h = np.minimum.reduceat(ids, runs[:-1]), h[runs[:-1]]
        bucket = (h % np.uint64(buckets)).astype("i8")
        order = np.argsort(bucket, kind="stable")
        h, ids, bucket = h[order], ids[order], bucket[order]
        ends = _groups(bucket) if len(h) else np.zeros(1, "i8")
        spans = list(zip(ends[:-1], ends[1:]))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                "hashes": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                "least": pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    both = docs.groupBy("block").cogroup(shared.groupBy("block"))
    return both.applyInArrow(extend, SHARED)


def _least_documents(found: DataFrame) -> DataFrame:
    """For each block, the windows that a smaller document of another block has."""

    def meet(key, table):
        h, row = _unpacked(table, "u8")
        own, _ = _unpacked(table, "i8", "least")
        order = np.argsort(h)
        h, own, block = h[order], own[order], np.asarray(table["block"])[row[order]]
        runs = _groups(h)
        least = np.repeat(np.minimum.reduceat(own, runs[:-1]), np.diff(runs)) if len(h) else own
        less = least < own
        h, least, block = h[less], least[less], block[less]
        order = np.argsort(block, kind="stable")
        h, least, block = h[order], least[order], block[order]
        ends = _groups(block) if len(h) else np.zeros(1, "i8")
        spans = list(zip(ends[:-1], ends[1:]))
        return pa.table(
            {
                "block": pa.array([int(block[a]) for a, _ in spans], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "hashes": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                "least": pa.array([least[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return found.groupBy("bucket").applyInArrow(meet, SHARED)


def _covered(places: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places the stretches of ``length`` from ``places`` cover."""
    change = np.zeros(n + 1, "i4")
    np.add.at(change, places, 1)
    np.add.at(change, places + length, -1)
    return np.cumsum(change[:n]) > 0


def kept_texts(words: Words, gone: np.ndarray) -> list[bytes]:
    """The words of each text that are not gone, joined by single blanks."""
    left = np.flatnonzero(~gone)
    owner = np.searchsorted(words.first, left, "right") - 1
    data, keep = words.data.copy(), np.zeros(len(words.data) + 1, "i4")
    np.add.at(keep, words.start[left], 1)
    np.add.at(keep, words.end[left], -1)
    keep = np.cumsum(keep[:-1]) > 0
    follows = np.zeros(len(left), bool)
    follows[1:] = owner[1:] == owner[:-1]
    # A word that follows another has a blank before it, whatever kind.
    before = words.start[left[follows]] - 1
    data[before], keep[before] = 0x20, True
    kept, ends = data[keep].tobytes(), np.concatenate(([0], np.cumsum(keep)))[words.at]
    return [kept[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _removed(docs: DataFrame, known: DataFrame, buckets: int, window: int) -> DataFrame:
    def remove(key, left, right):
        shared, far, far_least = _known(right)
        found = []
        for piece in pieces(left):
            part = Anchored(piece["text"], buckets, window)
            place, h = part.candidates(shared)
            ids = np.asarray(piece["doc_id"])
            owner = np.searchsorted(part.words.first, place, "right") - 1
            found.append((place, h, ids[owner], piece))
            del part
        h = np.concatenate([f[1] for f in found]) if found else np.empty(0, "u8")
        ids = np.concatenate([f[2] for f in found]) if found else np.empty(0, "i8")
        order = np.argsort(h)
        runs = _groups(h[order])
        least = np.empty(len(h), "i8")
        if len(h):
            least[order] = np.repeat(np.minimum.reduceat(ids[order], runs[:-1]), np.diff(runs))
        if len(far):
            at = np.minimum(np.searchsorted(far, h), len(far) - 1)
            least = np.where(far[at] == h, np.minimum(least, far_least[at]), least)
        out, at = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_sha256")}, 0
        for place, h, own, piece in found:
            repeated = place[least[at : at + len(h)] < own]
            at += len(h)
            words = Words(piece["text"])
            gone = _covered(repeated, window, len(words.hash))
            out["doc_id"] += piece["id"].to_pylist()
            out["n_words"] += words.counts.tolist()
            sums = np.concatenate(([0], np.cumsum(gone)))[words.first]
            out["n_removed"] += np.diff(sums).tolist()
            out["kept_sha256"] += [hashlib.sha256(t).hexdigest() for t in kept_texts(words, gone)]
        return pa.table({n: pa.array(v, pa.string() if n == "kept_sha256" else pa.int64()) for n, v in out.items()})

    both = docs.groupBy("block").cogroup(known.groupBy("block"))
    return both.applyInArrow(remove, KEPT)


def dedup_windows(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, one row per row of ``df``.

    Words are runs of anything but blanks and ASCII white space. A word goes if a window
    of ``window`` words that covers it also starts in a document with a smaller
    identifier; windows are those of the input, not of what is left. A null text is
    empty; a null identifier counts as larger than all others, and rows with the same
    identifier do not remove each other's words. Texts shorter than a window keep all."""
    if window <= PERIOD:
        raise ValueError(f"window must be more than {PERIOD} words")
    scratch = Scratch(df.sparkSession)
    whole = F.coalesce(col(text), F.lit(""))
    rows = df.select(col(doc_id).cast("long").alias("id"), whole.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = total // BLOCK_BYTES + 1, total // BUCKET_BYTES + 1
    docs = rows.withColumns(
        {
            "doc_id": F.coalesce("id", F.lit(LAST)),
            "block": F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long"),
        }
    )
    shared = scratch.keep(_shared_anchors(_anchors(docs, buckets, window)), "anchors")
    found = _windows(docs.select("block", "doc_id", "text"), shared, buckets, window)
    least = scratch.keep(_least_documents(found), "least")
    known = shared.unionByName(least)
    return scratch.keep(_removed(docs, known, buckets, window), "kept")
