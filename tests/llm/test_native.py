"""Exact dedup, mixing and sharding."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from velum.llm.exact_dedup import exact_dedup
from velum.llm.mixing import mix, mixed_sizes
from velum.llm.queries import ORACLE, QUERIES
from velum.llm.sharding import extendible_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, rows, keep):
    best, size = {}, Counter()
    for i, t, *_ in rows:
        t = t or ""
        size[t] += 1
        if i is not None:
            best[t] = (min if keep == "min" else max)(best.get(t, i), i)
    got = exact_dedup(docs, keep=keep, fan_in=2).collect()
    assert len(got) == len(rows)
    want = Counter(
        (i, best.get(t or ""), size[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, *_ in rows
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(size)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_bad_options(docs):
    with pytest.raises(ValueError):
        exact_dedup(docs, keep="first")
    with pytest.raises(ValueError):
        extendible_shards(docs, 0)


def test_empty_tables(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert mixed_sizes(no_docs).count() == 0
    assert mix(no_docs).count() == 0
    assert extendible_shards(no_docs, 100).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shared by weight, source by source, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if share * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def test_mixed_sizes(docs, rows):
    sizes, longest = Counter(), Counter()
    for _, t, _, s, *_ in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        longest[s] = max(longest[s], n)
    want = targets(sizes)
    got = mixed_sizes(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter(
        (i, len(WORD.findall(t or ""))) for i, t, *_ in rows
    )
    by_target = {round(v, 6): s for s, v in want.items()}
    taken = Counter()
    for r in got:
        source = by_target[round(r.target, 6)]
        assert r.source_size == sizes[source]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    again = mixed_sizes(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_is_near_its_targets_in_a_large_source(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("source"),
    )
    for r in mixed_sizes(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 50


def test_mix_rows(docs):
    plan = mixed_sizes(docs).agg(F.sum("taken")).first()[0]
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.select("text").collect()) == plan
    known = {tuple(r) for r in docs.select("doc_id", "text", "source").collect()}
    assert {tuple(r) for r in mixed.select("doc_id", "text", "source").collect()} <= known


@pytest.mark.parametrize("limit", [200, 5_000, 10**9])
def test_shards(docs, rows, limit):
    out = extendible_shards(docs, limit)
    assert out.columns == [*docs.columns, "shard", "shard_bytes", "shard_rows"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in rows)
    n, size = Counter(), Counter()
    for r in got:
        n[r.shard] += 1
        size[r.shard] += len((r.text or "").encode())
    for r in got:
        assert (r.shard_rows, r.shard_bytes) == (n[r.shard], size[r.shard])
        assert size[r.shard] <= limit or n[r.shard] == 1
    names = sorted(n)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    halves = defaultdict(int)
    for s in n:
        for k in range(len(s)):
            halves[s[:k]] += size[s]
    assert all(total > limit for total in halves.values())


def test_one_key_splits_too(spark):
    docs = spark.range(600).selectExpr("1L AS doc_id", "repeat('y', 50) AS text")
    got = extendible_shards(docs, 1_000).groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 600 and max(r.n for r in got) <= 20


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    got = QUERIES[name](spark, sf)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())
