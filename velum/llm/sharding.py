"""Shards by extendible hashing.

A document's key is hashed to a string of bits. A shard is a prefix of that string; the
directory starts with the empty prefix, and only a prefix whose documents exceed the byte
limit is split on its next bit. Sizes are summed once at a depth past the expected one and
rolled up to all shorter prefixes, so one pass settles nearly every shard; prefixes that
are still too large are summed again some bits deeper, and only their documents are read.

The first 60 bits come from the key. Rows with equal keys go on with 60 bits of a hash of
key and position, so that a key that fills a third of the table splits like any other."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import Scratch, col

BITS = 60
MORE_BITS = 8


def _bits(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    name = F.coalesce(col(key).cast("string"), F.lit(""))
    place = F.concat_ws("/", name, F.monotonically_increasing_id().cast("string"))
    return df.withColumns(
        {
            "_h1": _bits(name),
            "_h2": _bits(place),
            "_bytes": F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long"),
        }
    )


def _prefix(depth: int) -> list[Column]:
    """The prefix of ``depth`` bits as two numbers."""
    return [
        F.shiftright("_h1", max(0, BITS - depth)).alias("_p1"),
        F.shiftright("_h2", BITS - max(0, depth - BITS)).alias("_p2"),
    ]


def _settle(cells: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """All prefixes of ``start`` to ``depth`` bits with their sums and whether they fit."""
    up = F.col("depth")
    # Bits fall off the second number first.
    second = max(0, depth - BITS)
    rolled = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth))))
    return (
        rolled.withColumn("drop2", F.least(F.lit(depth) - up, F.lit(second)))
        .withColumn("drop1", F.lit(depth) - up - F.col("drop2"))
        .groupBy(
            "depth",
            F.expr("shiftright(_p1, drop1)").alias("_p1"),
            F.expr("shiftright(_p2, drop2)").alias("_p2"),
        )
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .withColumn("fits", (F.col("bytes") <= limit) | (F.col("n") <= 1))
    )


def _leaves(nodes: DataFrame, start: int) -> DataFrame:
    """Prefixes that fit while the next shorter one does not."""
    deep = F.col("depth") > BITS
    child = nodes.filter("fits").withColumns(
        {
            "u_depth": F.col("depth") - 1,
            "u1": F.when(deep, F.col("_p1")).otherwise(F.shiftright("_p1", 1)),
            "u2": F.when(deep, F.shiftright("_p2", 1)).otherwise(F.col("_p2")),
        }
    )
    full = nodes.filter("NOT fits").select(
        F.col("depth").alias("u_depth"), F.col("_p1").alias("u1"), F.col("_p2").alias("u2")
    )
    below = child.join(full, ["u_depth", "u1", "u2"], "left_semi")
    if start == 0:
        below = below.unionByName(child.filter("depth = 0"))
    return below.select("depth", "_p1", "_p2", "bytes", "n")


def directory(
    df: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """``depth, _p1, _p2, bytes, n``: one row per shard."""
    scratch = scratch or Scratch(df.sparkSession)
    rows = scratch.keep(_hashed(df.select(col(key), col(text)), key, text).select("_h1", "_h2", "_bytes"), "hashes")
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    start, depth = 0, ceil(log2(max(1, total / limit_bytes))) + 3
    found, open_rows, step = None, rows, 0
    while True:
        cells = open_rows.groupBy(*_prefix(depth)).agg(
            F.sum("_bytes").alias("bytes"), F.count("*").alias("n")
        )
        nodes = scratch.keep(_settle(cells, start, depth, limit_bytes), f"nodes{step}")
        leaves = _leaves(nodes, start)
        found = leaves if found is None else found.unionByName(leaves)
        full = nodes.filter(f"NOT fits AND depth = {depth}").select("_p1", "_p2")
        if depth == 2 * BITS or full.isEmpty():
            break
        open_rows = open_rows.withColumns(dict(zip(("_p1", "_p2"), _prefix(depth)))).join(
            full, ["_p1", "_p2"], "left_semi"
        ).drop("_p1", "_p2")
        start, depth, step = depth, min(2 * BITS, depth + MORE_BITS), step + 1
    rest = nodes.filter(f"NOT fits AND depth = {2 * BITS}").drop("fits")
    return scratch.keep(found.unionByName(rest), "directory")


def extendible_shards(
    df: DataFrame, limit_bytes: int = 64 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``df`` with ``shard`` (the bits of its prefix), ``shard_bytes`` and ``shard_rows``.

    Each shard holds at most ``limit_bytes`` bytes of text, but for a single document
    that is larger: it is a shard of its own. A null text has no bytes, a null key is
    hashed as an empty one, equal rows may end up in different shards. Columns of ``df``
    with the names of the result are replaced. An empty table gives no rows."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    made = ("shard", "shard_bytes", "shard_rows")
    df = df.drop(*[c for c in df.columns if c in made])
    leaves = directory(df, limit_bytes, key, text)
    n, deepest = leaves.agg(F.count("*"), F.max("depth")).first()
    # The directory proper has one entry for each value of its bits. It is doubled no
    # further than 16 entries a shard; a shard below that is found by its own prefix.
    depth = min(deepest or 0, ceil(log2(max(1, n))) + 4, BITS)
    entries = leaves.filter(f"depth <= {depth}").select(
        F.explode(
            F.expr(
                f"sequence(shiftleft(_p1, {depth} - depth), shiftleft(_p1 + 1, {depth} - depth) - 1)"
            )
        ).alias("_p1"),
        _named(),
    )
    deep = sorted(r[0] for r in leaves.filter(f"depth > {depth}").select("depth").distinct().collect())
    out = _hashed(df, key, text).withColumn("_p1", _prefix(depth)[0])
    out = out.join(entries, "_p1", "left").drop("_p1")
    for d in deep:
        p1, p2 = _prefix(d)
        own = leaves.filter(f"depth = {d}").select("_p1", "_p2", _named().alias("_more"))
        out = out.withColumns({"_p1": p1, "_p2": p2}).join(own, ["_p1", "_p2"], "left")
        out = out.withColumn("_leaf", F.coalesce("_leaf", "_more")).drop("_p1", "_p2", "_more")
    return out.select(
        *[col(c) for c in df.columns],
        F.col("_leaf.shard").alias("shard"),
        F.col("_leaf.bytes").alias("shard_bytes"),
        F.col("_leaf.n").alias("shard_rows"),
    )


def _named() -> Column:
    """A shard's prefix as text, with its totals."""
    first = F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(_p1), least(depth, {BITS}), '0') END")
    second = F.expr(f"CASE WHEN depth > {BITS} THEN lpad(bin(_p2), depth - {BITS}, '0') ELSE '' END")
    return F.struct(F.concat(first, second).alias("shard"), "bytes", "n").alias("_leaf")
