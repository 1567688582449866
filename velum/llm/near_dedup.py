"""Near-duplicates by improved consistent weighted sampling.

A text is the set of its five-word shingles, each weighted by its frequency in the text
and by how rare it is. Shingle frequencies over all documents go into a count-min sketch
whose size is fixed: what it cannot resolve is a fixed share of the documents, at any
size of the corpus, so shingles in fewer documents than that count as equally rare.

Each of ``SAMPLES`` consistent samples of a text is equal for two texts with the
probability of their weighted Jaccard similarity. Two samples make a band and each pair
of bands a key, so texts meet that agree in two bands. Texts that are the same go as one
from the start. Everything with the same key is compared with one leader instead of with
each other: pairs whose samples agree often enough are verified by the similarity itself,
and verified pairs are joined into components. Texts that meet at all form clusters; what
is not in the largest component of its cluster is then compared with the whole cluster,
in tiles, so that no link is lost where a leader was the wrong one. Clusters of more than
``LARGE`` texts are divided first, by the shingles that are rare in the cluster, in such a
way that every pair that is similar enough is together in some part: this saves
comparisons and loses none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.arrays import LOWER, Words, draws, mix, pieces
from velum.llm.shared import Scratch, col, give_back

SHINGLE = 5
THRESHOLD = 0.8
SAMPLES = 16
BAND = 2
AGREE, LOOSE = 8, 6
TILE, LARGE = 256, 1 << 16
ROWS, WIDTH = 3, 1 << 18
#: Bytes of text that are looked at together; hashes and samples take some 50 times that.
PIECE_BYTES = 1 << 20


class Shingles:
    """Distinct shingles of some texts in order, with how often each text has them. A
    text of fewer than five words is one shingle; one without words has none."""

    def __init__(self, texts):
        words = Words(texts, LOWER)
        place, h = words.windows(SHINGLE)
        owner = np.searchsorted(words.first, place, "right") - 1
        short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
        if len(short):
            whole = []
            for t in short:
                part = words.hash[words.first[t] : words.first[t + 1]]
                whole.append(mix(np.bitwise_xor.reduce(mix(part + draws(len(part), 3)), keepdims=True))[0])
            owner, h = np.concatenate((owner, short)), np.concatenate((h, np.array(whole, "u8")))
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.h, self.owner = h[at], owner[at]
        self.n = np.diff(np.concatenate((at, [len(h)])))
        self.texts = len(words.counts)


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (mix(h ^ draws(ROWS, 5)[row]) & np.uint64(WIDTH - 1)).astype("i8")


def shingle_sketch(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Count-min sketch of the number of texts that have a shingle, and that of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros((ROWS, WIDTH), "i8"), 0
        for batch in batches:
            for piece in pieces(batch, size=PIECE_BYTES):
                found = Shingles(piece.column("text"))
                n += found.texts
                for r in range(ROWS):
                    table[r] += np.bincount(_cells(found.h, r), minlength=WIDTH)
            give_back()
        # A slice of the sketch is one row, so the sum is spread over the cluster.
        for k, part in enumerate(table.reshape(-1, 1 << 12)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": [k], "cells": [part.tolist()], "n": [0]}, SKETCH)
        yield pa.RecordBatch.from_pydict({"k": [-1], "cells": [[]], "n": [n]}, SKETCH)

    parts = texts.select("text").mapInArrow(count, "k int, cells array<long>, n long")
    summed = parts.select("k", "n", F.posexplode_outer("cells").alias("at", "c"))
    summed = summed.groupBy("k", "at").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    found = summed.select("k", "at", "c", "n").toArrow()
    k, at = np.asarray(found["k"]), found["at"].fill_null(0).to_numpy()
    c = found["c"].fill_null(0).to_numpy()
    table = np.zeros(ROWS * WIDTH, "i8")
    real = k >= 0
    table[k[real] * (1 << 12) + at[real]] = c[real]
    return table.reshape(ROWS, WIDTH), int(np.asarray(found["n"])[~real].sum())


SKETCH = pa.schema([("k", pa.int32()), ("cells", pa.list_(pa.int64())), ("n", pa.int64())])


class Rarity:
    """Weight of shingles from 1 for the most common to 2 for those too rare to resolve."""

    def __init__(self, table: np.ndarray, n: int):
        self.table, self.n = table, max(1, n)
        self.noise = table.sum(1).mean() / WIDTH if n else 0.0
        self.rarest = max(2.0 * self.noise, 1.0) / self.n

    def __call__(self, h: np.ndarray) -> np.ndarray:
        count = self.table[0][_cells(h, 0)]
        for r in range(1, ROWS):
            count = np.minimum(count, self.table[r][_cells(h, r)])
        share = np.clip((count - self.noise) / self.n, self.rarest, 1.0)
        if self.rarest >= 1.0:
            return np.ones(len(h))
        return 1.0 + np.log(share) / np.log(self.rarest)


def consistent_samples(found: Shingles, weight: np.ndarray) -> np.ndarray:
    """``SAMPLES`` samples of every text; the row of a text without words is zero."""
    out = np.zeros((found.texts, SAMPLES), "u8")
    if not len(found.h):
        return out
    first = np.flatnonzero(np.concatenate(([True], found.owner[1:] != found.owner[:-1])))
    sizes = np.diff(np.concatenate((first, [len(found.h)])))
    log_w = np.log(weight)
    low = np.uint64(0xFFFFFFFF)
    scale, half = 1.0 / (1 << 32), 0.5
    for k, seed in enumerate(draws(SAMPLES, 9)):
        a = mix(found.h ^ seed)
        b = mix(a + np.uint64(0x9E3779B97F4A7C15))
        c = mix(b + np.uint64(0x9E3779B97F4A7C15))
        # Two gamma variates and a shift from five uniforms.
        r = -np.log(((a & low) + half) * scale * (((a >> np.uint64(32)) + half) * scale))
        log_c = np.log(-np.log(((b & low) + half) * scale * (((b >> np.uint64(32)) + half) * scale)))
        beta = ((c & low) + half) * scale
        t = np.floor(log_w / r + beta)
        value = log_c - r * (t - beta + 1.0)
        least = np.repeat(np.minimum.reduceat(value, first), sizes)
        at = np.flatnonzero(value == least)
        owner = found.owner[at]
        at = at[np.concatenate(([True], owner[1:] != owner[:-1]))]
        code = mix(found.h[at] ^ mix(t[at].astype("i8").view("u8") ^ seed))
        out[found.owner[at], k] = np.maximum(code, 1)
    return out


SIGNED = "doc_id long, mark long, words boolean, samples array<long>"


def _signatures(texts: DataFrame, rarity) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Rarity(*rarity.value)
        for batch in batches:
            for piece in pieces(batch, size=PIECE_BYTES):
                found = Shingles(piece.column("text"))
                codes = consistent_samples(found, found.n * weigh(found.h))
                ends = np.arange(0, codes.size + 1, SAMPLES, dtype="i4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": piece.column("doc_id"),
                        "mark": piece.column("mark"),
                        "words": pa.array(codes.any(1)),
                        "samples": pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(codes.view("i8").ravel())
                        ),
                    }
                )
                del found, codes
            give_back()

    return texts.select("doc_id", "mark", "text").mapInArrow(sign, SIGNED)


def _keyed(signed: DataFrame) -> DataFrame:
    """``mark, key`` for every pair of bands of a text."""
    n = SAMPLES // BAND
    bands = [F.xxhash64(F.lit(i), *[F.get("samples", F.lit(i * BAND + j)) for j in range(BAND)]) for i in range(n)]
    keys = F.array(*[F.xxhash64(bands[i], bands[j], F.lit(i * n + j)) for i in range(n) for j in range(i)])
    return signed.select("mark", F.explode(keys).alias("key"))


def _similar(texts, weigh: Rarity, threshold: float) -> np.ndarray:
    """Which of the pairs of consecutive texts are similar enough."""
    found = Shingles(texts)
    w, pair = found.n * weigh(found.h), found.owner // 2
    order = np.lexsort((found.h, pair))
    h, w, pair = found.h[order], w[order], pair[order]
    twice = np.flatnonzero((h[1:] == h[:-1]) & (pair[1:] == pair[:-1]))
    n = found.texts // 2
    both = np.bincount(pair[twice], np.minimum(w[twice], w[twice + 1]), n)
    total = np.bincount(pair, w, n) - both
    return (total > 0) & (both >= threshold * total)


def _verified(pairs: DataFrame, texts: DataFrame, rarity, threshold: float) -> DataFrame:
    """Pairs of marks (``a``, ``b``) whose texts are similar enough. Each pair gets the
    rows of its two texts, next to each other, whatever number of pairs a text is in."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, rest = Rarity(*rarity.value), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None and rest.num_rows:
                table = pa.concat_tables([rest, table])
            at, whole = 0, table.num_rows - table.num_rows % 2
            ends = np.cumsum(pc.binary_length(table["text"]).to_numpy())
            while at < whole:
                before = ends[at - 1] if at else 0
                stop = int(np.searchsorted(ends, before + PIECE_BYTES, "right"))
                stop = min(whole, max(at + 2, stop - (stop - at) % 2))
                part = table.slice(at, stop - at)
                same = _similar(part["text"], weigh, threshold)
                first = part.take(np.flatnonzero(same) * 2)
                yield from first.select(["a", "b"]).combine_chunks().to_batches()
                at = stop
            rest = table.slice(whole)

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("mark"))
    sent = texts.join(ends, "mark").select("a", "b", "text")
    dealt = sent.repartition("a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``mark, root``: the least mark each mark is connected to. Roots move to the least
    root among the neighbours' and then to their own root, so the steps needed grow with
    the logarithm of the longest chain."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.distinct(), f"{name}-edges")
    roots = scratch.keep(
        both.groupBy(F.col("a").alias("mark")).agg(F.least(F.min("b"), F.col("mark")).alias("root")),
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        seen = both.join(roots.select(F.col("mark").alias("b"), "root"), "b")
        near = seen.groupBy(F.col("a").alias("mark")).agg(F.min("root").alias("near"))
        # What a neighbour offers is passed on to the root itself as well.
        offers = roots.join(near, "mark")
        lower = (
            offers.select("mark", F.least("root", "near").alias("root"))
            .unionByName(offers.select(F.col("root").alias("mark"), F.least("root", "near").alias("root")))
            .groupBy("mark")
            .agg(F.min("root").alias("root"))
        )
        up = lower.select(F.col("mark").alias("root"), F.col("root").alias("top"))
        moved = scratch.keep(
            lower.join(up, "root", "left").select("mark", F.coalesce("top", "root").alias("root")),
            f"{name}-{step}",
        )
        changed = moved.join(roots, ["mark", "root"], "left_anti").isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        roots = moved
        if changed:
            return roots


def _meetings(buckets: DataFrame, once: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b, agree``: the members of each key with its least mark as leader, and how
    many of their samples agree, from ``LOOSE`` on."""
    leaders = buckets.groupBy("key").agg(F.min("mark").alias("leader"))
    leaders = scratch.keep(leaders, "leaders")
    pairs = (
        buckets.join(leaders, "key")
        .filter("mark <> leader")
        .select(F.least("mark", "leader").alias("a"), F.greatest("mark", "leader").alias("b"))
        .distinct()
    )
    left = once.select(F.col("mark").alias("a"), F.col("samples").alias("x"))
    right = once.select(F.col("mark").alias("b"), F.col("samples").alias("y"))
    agree = F.expr("size(filter(zip_with(x, y, (p, q) -> p = q), e -> e))")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", agree.alias("agree"))
    met = scratch.keep(met.filter(f"agree >= {LOOSE}"), "met")
    scratch.drop("leaders")
    return met


def _clusters(loose: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """``mark, cluster, root, size, n_rest, rest``: the clusters of texts that may be
    similar, with the component of each text and whether that is another one than the
    largest of its cluster. Clusters of two, and those that are one component, are done."""
    state = components(loose, scratch, "loose").withColumnRenamed("root", "cluster")
    state = state.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    return _unsettled(scratch.keep(state, "state"), 3, scratch, "cluster")


def _unsettled(state: DataFrame, least: int, scratch: Scratch, name: str) -> DataFrame:
    """The clusters (``mark, cluster, root``) of ``least`` texts or more that are not one
    component, with ``size, n_rest, rest``."""
    parts = state.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("main")
    )
    totals = totals.withColumn("n_rest", F.col("size") - F.col("main.n")).filter(f"size >= {least} AND n_rest > 0")
    totals = scratch.keep(totals.select("cluster", "size", "n_rest", F.col("main.root").alias("main")), f"{name}-totals")
    state = state.join(totals, "cluster").withColumn("rest", F.col("root") != F.col("main"))
    return scratch.keep(state.drop("main"), f"{name}-state")


def _divided(state: DataFrame, texts: DataFrame, rarity, threshold: float, scratch: Scratch) -> DataFrame:
    """Large clusters divided into parts, one for each shingle, as ``_unsettled`` has them.

    The shingles of a text are put in order, those in the fewest texts of the cluster first,
    and it goes into the parts of its first ones, as long as what is from there on holds
    the share ``threshold`` of its weight. Of the shingles that two similar texts share, the first
    one is among these for both, since what they share is all behind it and holds that
    share of each; so each such pair is in a part."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Rarity(*rarity.value)
        for batch in batches:
            for piece in pieces(batch, size=PIECE_BYTES):
                found = Shingles(piece.column("text"))
                own = {c: piece.column(c).take(pa.array(found.owner)) for c in ("mark", "cluster", "root")}
                w = found.n * weigh(found.h)
                yield from pa.table({**own, "h": found.h.view("i8"), "w": w}).to_batches(1 << 16)

    sent = texts.join(state.select("mark", "cluster", "root"), "mark").select("mark", "cluster", "root", "text")
    rows = sent.mapInArrow(shingles, "mark long, cluster long, root long, h long, w double")
    rows = scratch.keep(rows, "shingles")
    often = rows.groupBy("cluster", "h").agg(F.count("*").alias("k"))
    whole = Window.partitionBy("mark")
    behind = whole.orderBy(F.desc("k"), F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)
    # A little less than the share, for sums that are rounded.
    enough = F.sum("w").over(behind) >= threshold * (1 - 1e-9) * F.sum("w").over(whole)
    first = rows.join(often, ["cluster", "h"]).withColumn("first", enough).filter("first AND k > 1")
    parts = first.select("mark", F.xxhash64("cluster", "h").alias("cluster"), "root").distinct()
    return _unsettled(scratch.keep(parts, "parts"), 2, scratch, "part")


def _rest(state: DataFrame, texts: DataFrame, rarity, threshold: float) -> DataFrame:
    """Links of the texts outside the largest component of their cluster, each compared
    with all texts of the cluster, in tiles of bounded size. One link is given to each
    component that a text is linked to."""

    def compare(key, table):
        table = table.combine_chunks()
        rest = np.asarray(table["own"])
        marks, roots = np.asarray(table["mark"]), np.asarray(table["root"])
        found = Shingles(table["text"])
        rare = Rarity(*rarity.value)(found.h)
        n = found.texts
        sums = np.bincount(found.owner, found.n * rare, n)
        names, column, times = np.unique(found.h, return_inverse=True, return_counts=True)
        weight = np.zeros(len(names))
        weight[column] = rare
        both = np.zeros((rest.sum(), (~rest).sum()))
        row = np.where(rest, np.cumsum(rest) - 1, np.cumsum(~rest) - 1)
        shared = np.flatnonzero(times > 1)
        for at in range(0, len(shared), 2048):
            part = shared[at : at + 2048]
            place = np.full(len(names), -1)
            place[part] = np.arange(len(part))
            inside = np.flatnonzero(place[column] >= 0)
            sides = [np.zeros((m, len(part)), "f8") for m in both.shape]
            for side, mine in zip(sides, (rest, ~rest)):
                e = inside[mine[found.owner[inside]]]
                side[row[found.owner[e]], place[column[e]]] = found.n[e]
            one, two = sides
            often = np.minimum(one.max(0, initial=0), two.max(0, initial=0)) > 1
            once = ~often
            both += ((one[:, once] > 0) * weight[part][once]) @ (two[:, once] > 0).T
            for c in np.flatnonzero(often):
                both += weight[part[c]] * np.minimum.outer(one[:, c], two[:, c])
        total = sums[rest][:, None] + sums[~rest][None, :] - both
        linked = (both >= threshold * total) & (total > 0) & (roots[rest][:, None] != roots[~rest][None, :])
        i, j = np.nonzero(linked)
        first = np.unique(np.stack((i, roots[~rest][j])), axis=1, return_index=True)[1] if len(i) else i
        x, y = marks[rest][i[first]], marks[~rest][j[first]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    tiles = F.ceil(F.col("n_rest") / TILE).cast("int"), F.ceil(F.col("size") / (4 * TILE)).cast("int")
    hashed = F.xxhash64("mark", F.lit(0))
    every = [F.sequence(F.lit(0), t - 1) for t in tiles]
    mine = [F.pmod(hashed, t).cast("int") for t in tiles]
    own = state.filter("rest").select(
        "mark", "root", "cluster", F.lit(True).alias("own"), mine[0].alias("i"), F.explode(every[1]).alias("j")
    )
    others = state.select(
        "mark", "root", "cluster", F.lit(False).alias("own"), F.explode(every[0]).alias("i"), mine[1].alias("j")
    )
    sent = texts.join(own.unionByName(others), "mark")
    return sent.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def _classes(df: DataFrame, text: str, doc_id: str, threshold: float, scratch: Scratch) -> DataFrame:
    """``doc_id, mark, root, n_links``: one row per row of ``df``."""
    whole = F.coalesce(col(text), F.lit(""))
    rows = df.select(col(doc_id).cast("long").alias("doc_id"), whole.alias("text")).withColumn(
        "mark", F.xxhash64("text")
    )
    rarity = df.sparkSession.sparkContext.broadcast(shingle_sketch(rows))
    signed = scratch.keep(_signatures(rows, rarity), "signed")
    once = signed.filter("words").groupBy("mark").agg(F.first("samples").alias("samples"))
    once = scratch.keep(once, "once")
    keyed = _keyed(once)
    crowded = keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    buckets = scratch.keep(keyed.join(crowded, "key", "left_semi"), "buckets")
    loose = _meetings(buckets, once, scratch)
    tested = loose.filter(f"agree >= {AGREE}").select("a", "b")
    near = buckets.select("mark").distinct()
    texts = rows.select("mark", "text").join(near, "mark", "left_semi").dropDuplicates(["mark"])
    texts = scratch.keep(texts, "texts")
    edges = scratch.keep(_verified(tested, texts, rarity, threshold), "links0")
    roots = components(edges, scratch, "round0")
    state = _clusters(loose, roots, scratch)
    fit, large = state.filter(f"size <= {LARGE}"), state.filter(f"size > {LARGE}")
    found = _rest(fit, texts, rarity, threshold)
    if not large.isEmpty():
        parts = _divided(large, texts, rarity, threshold, scratch)
        found = found.unionByName(_rest(parts, texts, rarity, threshold)).distinct()
    found = scratch.keep(found, "rest")
    edges = edges.unionByName(found)
    roots = components(edges, scratch, "clusters")
    named = signed.select("doc_id", "mark")
    links = edges.select(F.explode(F.array("a", "b")).alias("mark")).groupBy("mark").agg(
        F.count("*").alias("n_links")
    )
    linked = scratch.keep(roots.join(links, "mark", "left"), "linked")
    return named.join(linked, "mark", "left").select(
        "doc_id", "mark", F.coalesce("root", "mark").alias("root"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, mark, class_id, group_size, n_links``, one row per row of ``df``.

    ``class_id`` is the least identifier among the documents that verified links connect
    with it (null if none has one), ``group_size`` their number, ``n_links`` the number of
    verified links of its text. Null texts are empty; texts without words are only equal
    to themselves. Equal texts share ``mark``, the hash of the text, and are one class.
    An empty table gives no rows; other columns are not read."""
    scratch = Scratch(df.sparkSession)
    named = scratch.keep(_classes(df, text, doc_id, threshold, scratch), "classes")
    sizes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("group_size"))
    sizes = scratch.keep(sizes, "sizes")
    return named.join(sizes, "root").select("doc_id", "mark", "class_id", "group_size", "n_links")


def keep_one(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``df`` with the least identifier of each class; of equal rows one."""
    scratch = Scratch(df.sparkSession)
    named = _classes(df, text, doc_id, threshold, scratch)
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark"))
    kept = named.groupBy("root").agg(best.alias("best")).select(
        F.col("best.doc_id").alias("_doc"), F.col("best.mark").alias("_mark")
    )
    kept = scratch.keep(kept, "kept")
    marked = df.withColumns(
        {"_doc": col(doc_id).cast("long"), "_mark": F.xxhash64(F.coalesce(col(text), F.lit("")))}
    )
    same = marked["_doc"].eqNullSafe(kept["_doc"]) & (marked["_mark"] == kept["_mark"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["_doc", "_mark"]).drop("_doc", "_mark")
