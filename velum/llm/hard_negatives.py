"""Hard negatives by exact search in a multiway tree of split points.

The tree is fitted to a bounded sample: a node has some split points that lie far apart,
and a row belongs to the child whose split point is nearest. All rows are then placed, and
over all of them each split point gets the range of its distances to the rows of every
sibling. Inner products become distances by one more component that brings all rows to the
same length (anchors have 0 there), so a window of scores is an annulus around the anchor.
A child is left out if, for some split point, the distances that the annulus allows do not
meet its range. What is left is compared exactly.

Anchors go in blocks of at most ``BLOCK``, in the order of their leaves. For a block, the
leaves nearest to each anchor are searched first; what they give narrows the windows, and
the leaves that still meet one are searched after. Rows are stored in the order of the
leaves and by ranges of the identifier within, so a block reads the leaves it needs only,
and a leaf with many rows is spread over tasks. A task keeps the best rows of each window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import Scratch, col, fraction

SAMPLE, FANOUT, LEAF = 8192, 16, 48
PROBED = 6
BLOCK = 4096
ROWS = 1024
EXACT = 1 << 53


@dataclass
class Node:
    points: np.ndarray
    children: list  # of Node or the number of a leaf
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    """A tree over vectors of ``dim`` components and one that lifts them to ``length``."""

    dim: int
    length: float
    root: Node | int
    nodes: list[Node]
    leaves: int
    points: np.ndarray  # the split point of each leaf


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros behind."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "i4")[column.offset : column.offset + len(column) + 1]
    if len(column) and (np.diff(ends) == 4 * dim).all():
        return np.frombuffer(data or b"", "u1")[ends[0] : ends[-1]].copy().view("i4").reshape(-1, dim).astype("f8")
    for i, v in enumerate(column):
        part = np.frombuffer(v.as_buffer(), "i4")
        out[i, : len(part)] = part
    return out


def _lifted(v: np.ndarray, length: float) -> np.ndarray:
    left = np.maximum(length**2 - (v * v).sum(1), 0.0)
    return np.concatenate((v, np.sqrt(left)[:, None]), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def fit_tree(sample: np.ndarray, length: float, fanout: int = FANOUT, leaf: int = LEAF) -> Tree:
    """A tree over the rows of ``sample``; its leaves hold ``leaf`` of them or fewer."""
    lifted = _lifted(sample, length)
    tree = Tree(sample.shape[1], length, 0, [], 0, np.empty((0, lifted.shape[1])))
    points = []

    def grow(rows: np.ndarray, point: np.ndarray):
        apart = np.empty(0, "i8")
        if len(rows) > leaf:
            # The next split point is the row farthest from those there are.
            near = _distances(lifted[rows], lifted[rows[:1]])[:, 0]
            chosen = [int(np.argmax(near))]
            near = np.full(len(rows), np.inf)
            while len(chosen) < fanout:
                near = np.minimum(near, _distances(lifted[rows], lifted[rows[chosen[-1:]]])[:, 0])
                if near.max() <= 1e-6 * max(1.0, length):
                    break
                chosen.append(int(np.argmax(near)))
            apart = rows[chosen]
        if len(apart) < 2:
            points.append(point)
            return len(points) - 1
        node = Node(lifted[apart], [])
        tree.nodes.append(node)
        side = _distances(lifted[rows], node.points).argmin(1)
        node.children = [grow(rows[side == j], node.points[j]) for j in range(len(apart))]
        return node

    tree.root = grow(np.arange(len(lifted)), np.zeros(lifted.shape[1]))
    tree.leaves, tree.points = len(points), np.stack(points)
    return tree


def _descend(tree: Tree, lifted: np.ndarray) -> Iterator[tuple[Node, np.ndarray, np.ndarray, np.ndarray]]:
    """For each node: the rows in it, their distances to its points, and their child."""
    todo = [(tree.root, np.arange(len(lifted)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, Node) and len(rows):
            d = _distances(lifted[rows], node.points)
            side = d.argmin(1)
            yield node, rows, d, side
            todo += [(child, rows[side == j]) for j, child in enumerate(node.children)]


def place(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    leaf = np.zeros(len(vectors), "i4")
    for node, rows, _, side in _descend(tree, _lifted(vectors, tree.length)):
        numbers = np.array([-1 if isinstance(c, Node) else c for c in node.children])
        leaf[rows] = np.where(numbers[side] >= 0, numbers[side], leaf[rows])
    return leaf


def alive(tree: Tree, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which leaves (columns) may hold rows of a window of each anchor (rows). ``low`` and
    ``high`` are scores, a row for each anchor and a column for each window; a window whose
    low end is above its high end is empty."""
    out = np.zeros((len(anchors), tree.leaves), bool)
    some = low <= high
    whole = (anchors * anchors).sum(1)[:, None] + tree.length**2
    near = np.sqrt(np.maximum(whole - 2 * np.minimum(high, 1e300), 0.0))
    far = np.sqrt(np.maximum(whole - 2 * np.maximum(low, -1e300), 0.0))
    zero = np.concatenate((anchors, np.zeros((len(anchors), 1))), axis=1)
    slack = 1e-6 * (1.0 + tree.length + np.sqrt(whole))
    todo = [(tree.root, some)]
    while todo:
        node, open_ = todo.pop()
        if not isinstance(node, Node):
            out[:, node] = open_.any(1)
            continue
        d = _distances(zero, node.points)
        left = [open_.copy() for _ in node.children]
        for i in range(len(node.points)):
            least = np.maximum(d[:, i, None] - far, near - d[:, i, None]) - slack
            most = d[:, i, None] + far + slack
            for j in range(len(node.children)):
                left[j] &= (node.high[i, j] >= least) & (node.low[i, j] <= most)
        todo += [(c, o) for c, o in zip(node.children, left) if o.any()]
    return out


def _measure(placed: DataFrame, tree: Tree) -> None:
    """Set the ranges of distances between split points and siblings, over all rows."""
    sent = placed.sparkSession.sparkContext.broadcast(tree)

    def measure(batches):
        tree = sent.value
        at = {id(n): k for k, n in enumerate(tree.nodes)}
        low = [np.full((len(n.points),) * 2, np.inf) for n in tree.nodes]
        high = [np.full((len(n.points),) * 2, -np.inf) for n in tree.nodes]
        for batch in batches:
            lifted = _lifted(_vectors(batch.column("v"), tree.dim), tree.length)
            for node, _, d, side in _descend(tree, lifted):
                k = at[id(node)]
                for j in np.unique(side):
                    low[k][:, j] = np.minimum(low[k][:, j], d[side == j].min(0))
                    high[k][:, j] = np.maximum(high[k][:, j], d[side == j].max(0))
        for k, (a, b) in enumerate(zip(low, high)):
            i, j = np.nonzero(a <= b)
            node = np.full(len(i), k, "i4")
            yield pa.RecordBatch.from_pydict(
                {"node": node, "i": i.astype("i4"), "j": j.astype("i4"), "low": a[i, j], "high": b[i, j]}
            )

    parts = placed.select("v").mapInArrow(measure, "node int, i int, j int, low double, high double")
    ranges = parts.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    for node in tree.nodes:
        node.low = np.full((len(node.points),) * 2, np.inf)
        node.high = np.full((len(node.points),) * 2, -np.inf)
    for r in ranges.to_pylist():
        tree.nodes[r["node"]].low[r["i"], r["j"]] = r["low"]
        tree.nodes[r["node"]].high[r["i"], r["j"]] = r["high"]


@dataclass
class Block:
    """Some anchors: identifiers, labels, vectors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


@dataclass
class Search:
    """What to look for around the anchors of a block: in the leaves that are ``open`` for
    an anchor, the first ``k`` rows of each window, of the same label or of another."""

    open: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


def _best(found: tuple, windows: int, k: int) -> tuple:
    """The first ``k`` of each anchor and window: higher scores first, ties by identifier,
    those without one last."""
    a, w, score, none, ids = found
    order = np.lexsort((ids, none, -score, a * windows + w))
    group = (a * windows + w)[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else group
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.concatenate((first, [len(group)]))))
    order = order[place < k]
    return tuple(x[order] for x in found)


FOUND = "a int, w int, score double, vec_id long"


def _search(placed: DataFrame, tree: Tree, block: Block, what: Search) -> DataFrame:
    """``a, w, score, vec_id``: the best rows of every window, some from each task."""
    leaves = np.flatnonzero(what.open.any(0)).tolist()
    sent = placed.sparkSession.sparkContext.broadcast((block, what))
    dim, windows = tree.dim, what.low.shape[1]

    def search(batches):
        block, what = sent.value
        kept, held = [], 0
        for batch in batches:
            leaf, label = np.asarray(batch.column("leaf")), np.asarray(batch.column("label"))
            none = np.asarray(batch.column("vec_id").is_null())
            ids = np.asarray(batch.column("vec_id").fill_null(np.iinfo("i8").max))
            vectors = _vectors(batch.column("v"), dim)
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            for some in np.split(order, cuts):
                mine = np.flatnonzero(what.open[:, leaf[some[0]]]) if len(some) else some
                for at in range(0, len(some) if len(mine) else 0, ROWS):
                    rows = some[at : at + ROWS]
                    score = block.vectors[mine] @ vectors[rows].T
                    fits = (block.labels[mine][:, None] == label[rows][None, :]) == what.same
                    fits &= (block.ids[mine][:, None] != ids[rows][None, :]) | none[rows][None, :]
                    for w in range(windows):
                        inside = fits & (score >= what.low[mine, w, None]) & (score <= what.high[mine, w, None])
                        i, j = np.nonzero(inside)
                        part = mine[i], np.full(len(i), w), score[i, j], none[rows[j]], ids[rows[j]]
                        part = _best(part, windows, what.k)
                        kept.append(part)
                        held += len(part[0])
                    if held > 1 << 18:
                        kept = [_best(tuple(map(np.concatenate, zip(*kept))), windows, what.k)]
                        held = 0
        if kept:
            a, w, score, none, ids = _best(tuple(map(np.concatenate, zip(*kept))), windows, what.k)
            columns = {"a": a.astype("i4"), "w": w.astype("i4"), "score": score, "vec_id": pa.array(ids, mask=none)}
            yield from pa.table(columns).to_batches(1 << 16)

    return placed.filter(F.col("leaf").isin(leaves)).mapInArrow(search, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor and window, with ``rank`` from 1."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.isnull("vec_id").alias("n"), "vec_id")))
    best = found.groupBy("a", "w").agg(F.slice(best, 1, k).alias("best"))
    return best.select("a", "w", F.posexplode("best").alias("rank", "b")).select(
        "a", "w", (F.col("rank") + 1).alias("rank"), (-F.col("b.s")).alias("score"), "b.vec_id"
    )


def _nearest(tree: Tree, vectors: np.ndarray, n: int) -> np.ndarray:
    """Marks at the ``n`` leaves whose split points are nearest."""
    zero = np.concatenate((vectors, np.zeros((len(vectors), 1))), axis=1)
    d = _distances(zero, tree.points)
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, np.argsort(d, axis=1)[:, :n], True, axis=1)
    return out


def _windows(placed, tree: Tree, block: Block, low, high, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each window: the nearest leaves, then all that are left."""
    near = _nearest(tree, block.vectors, PROBED) & alive(tree, block.vectors, low, high)
    probe = _first(_search(placed, tree, block, Search(near, low, high, same, k)), k).filter(F.col("rank") == k)
    reached = low.copy()
    for a, w, score in zip(*[c.to_pylist() for c in probe.select("a", "w", "score").toArrow().columns]):
        reached[a, w] = max(reached[a, w], score)
    left = alive(tree, block.vectors, reached, high)
    return _first(_search(placed, tree, block, Search(left, reached, high, same, k)), k)


def _blocks(anchors: DataFrame, dim: int) -> Iterator[Block]:
    """Anchors in the order of their leaves, a bounded number at a time."""
    rows = []
    for row in anchors.orderBy("leaf", "vec_id").select("vec_id", "label", "v").toLocalIterator():
        rows.append(row)
        if len(rows) == BLOCK:
            yield _block(rows, dim)
            rows = []
    if rows:
        yield _block(rows, dim)


def _block(rows: list, dim: int) -> Block:
    vectors = _vectors(pa.array([bytes(r["v"]) for r in rows], pa.binary()), dim)
    return Block(np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), vectors)


def _prepared(df: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, v, size, norm`` of the rows that take part."""
    sound = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        col(vec_id).cast("long").alias("vec_id"),
        col(label).cast("long").alias("label"),
        F.transform(col(vector), lambda x: F.lit(float(scale)) * x.cast("double")).alias("x"),
    ).filter(F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(sound, F.lit(False)))

    def prepare(batches):
        for batch in batches:
            x = batch.column("x")
            flat = np.floor(x.flatten().to_numpy(zero_copy_only=False))
            size = x.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(size)), size)
            # Beyond this the square does not fit; the check of the norm refuses it.
            kept = np.clip(flat, -(2.0**31), 2.0**31 - 1).astype("i4")
            ends = np.concatenate(([0], np.cumsum(4 * size))).astype("i4")
            v = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
            norm = np.bincount(owner, flat * flat, len(size)) if len(flat) else np.zeros(len(size))
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": v, "size": size.astype("i4"), "norm": norm}
            )

    return rows.mapInArrow(prepare, "vec_id long, label long, v binary, size int, norm double")


def hard_negatives(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchors: str = "vec_id % 100 = 0",
    relabel=None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    sample: int = SAMPLE,
    leaf: int = LEAF,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of the vectors times ``scale``, rounded down. ``anchors``
    is a condition over ``vec_id, label``; an anchor's positives are its first rows of the
    same label with another identifier, its negatives for a positive the first rows of
    other labels with ``low`` to ``high`` percent of the positive's score. Higher scores
    come first, ties by identifier. ``relabel`` makes a label from ``vec_id`` and ``label``.

    Rows without a label or a vector, or with a component that is null or not finite, take
    no part. Missing components at the end are 0. A row without an identifier is no anchor
    and comes last among ties. Repeated rows are rows of their own. Vectors so long that
    scores may pass 2^53 raise. An empty table gives no rows. The tree is fitted to
    ``sample`` rows, those with the least hashes; all rows are placed and searched."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = _prepared(df, vec_id, vector, label, scale)
    if relabel is not None:
        rows = rows.withColumn("label", relabel(F.col("vec_id"), F.col("label")).cast("long"))
    rows = scratch.keep(rows, "rows")
    n, dim, norm = rows.agg(F.count("*"), F.max("size"), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], schema)
    if norm >= EXACT:
        raise ValueError("scores of these vectors may pass 2^53 and would not be exact")
    # Few more than are needed leave their tasks.
    some = rows.select("v", fraction(F.col("v"), F.col("vec_id")).alias("h")).filter(F.col("h") < min(1.0, 2 * sample / n))
    some = some.orderBy("h").limit(sample).select("v").toArrow()
    tree = fit_tree(_vectors(some["v"], dim) if len(some) else np.zeros((1, dim)), float(np.sqrt(norm)), leaf=leaf)
    sent = spark.sparkContext.broadcast(tree)

    def put(batches):
        for batch in batches:
            leaves = place(sent.value, _vectors(batch.column("v"), sent.value.dim))
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("vec_id", "label", "v")}, "leaf": leaves})

    parts = max(spark.sparkContext.defaultParallelism, n >> 14)
    placed = rows.mapInArrow(put, "vec_id long, label long, v binary, leaf int")
    placed = placed.repartitionByRange(parts, "leaf", "vec_id").sortWithinPartitions("leaf")
    placed = scratch.keep(placed, "placed")
    scratch.drop("rows")
    _measure(placed, tree)
    steps = 0
    for block in _blocks(placed.filter(anchors), dim):
        every = np.full((len(block.ids), 1), -np.inf)
        near = _windows(placed, tree, block, every, -every, True, positives)
        near = near.toArrow().to_pylist()
        lows, highs = (np.full((len(block.ids), positives), x) for x in (np.inf, -np.inf))
        for p in near:
            score = int(p["score"])
            lows[p["a"], p["rank"] - 1] = -(-low * score // 100)
            highs[p["a"], p["rank"] - 1] = high * score // 100
        found = _windows(placed, tree, block, lows, highs, False, negatives)
        names = [(p["a"], p["rank"] - 1, int(block.ids[p["a"]]), p["vec_id"], int(p["score"])) for p in near]
        names = spark.createDataFrame(names, "a int, w int, anchor_id long, positive_id long, positive_score long")
        found = found.join(names, ["a", "w"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").cast("long").alias("negative_score"),
        )
        scratch.keep(found, f"found/block={steps}")
        steps += 1
    if not steps:
        return spark.createDataFrame([], schema)
    paths = [f"{scratch.root}/found/block={k}" for k in range(steps)]
    return spark.read.schema(schema).parquet(*paths)
