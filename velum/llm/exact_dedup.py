"""Exact deduplication by a tree merge of digest runs.

Each input partition makes a run: one row per digest it holds, with the best identifier
and the number of rows. Runs then merge in rounds, ``fan_in`` runs into one, and each
round keeps the best identifier per digest. A round is an aggregation keyed by run and
digest, so every run is spread over the cluster by digest and a text that fills a third
of the table arrives as one row per run. The outcome goes down the same way: first to the
rows of the first runs, then to the documents of each run, so that no task gets all
copies of a text.

Texts are taken as equal when SHA-256, length in bytes and an unrelated 64-bit hash agree;
all three are part of every key, so each level verifies what the level below merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import Scratch, col

DIGEST = ("sha", "n_bytes", "mark")


def digest_runs(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, row, run, sha, n_bytes, mark``, one row per row of ``df``."""
    whole = F.coalesce(col(text), F.lit(""))
    return df.select(
        col(doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().cast("long").alias("run"),
        F.sha2(whole, 256).alias("sha"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.xxhash64(whole).alias("mark"),
    )


def _best(keep: str):
    """The row that stays: by identifier, rows without one last, then by position."""
    if keep == "min":
        return F.min(F.struct(F.isnull("best_id").alias("none"), "best_id", "best_row"))
    return F.max(F.struct(F.isnotnull("best_id").alias("some"), "best_id", "best_row"))


def _merged(runs: DataFrame, keep: str) -> DataFrame:
    return (
        runs.groupBy("run", *DIGEST)
        .agg(_best(keep).alias("best"), F.sum("n").alias("n"))
        .select("run", *DIGEST, "best.best_id", "best.best_row", "n")
    )


def exact_dedup(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: str = "min",
    fan_in: int = 16,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest (``keep="min"``) or largest (``"max"``)
    identifier stays. A null text counts as empty. A null identifier loses to any other;
    of rows with the same text and identifier exactly one stays. Other columns of ``df``
    are not read. An empty table gives no rows."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep}")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    scratch = Scratch(df.sparkSession)
    rows = scratch.keep(digest_runs(df, text, doc_id), "digests")
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    first = _merged(
        rows.select(
            "run", *DIGEST, F.col("doc_id").alias("best_id"), F.col("row").alias("best_row"),
            F.lit(1).cast("long").alias("n"),
        ),
        keep,
    )
    first = scratch.keep(first, "runs")
    merged = first
    while n_runs > 1:
        merged = _merged(merged.withColumn("run", F.expr(f"run div {fan_in}")), keep)
        n_runs = -(-n_runs // fan_in)
    groups = merged.filter("n > 1").select(
        *DIGEST,
        F.col("best_id").alias("keep_id"),
        F.col("best_row").alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    held = first.select("run", *DIGEST).join(groups, list(DIGEST))
    single = F.isnull("group_size")
    return (
        rows.join(held, ["run", *DIGEST], "left")
        .select(
            "doc_id",
            F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
