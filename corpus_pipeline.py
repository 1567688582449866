"""A corpus from raw documents in five stages; each reads what the one before it wrote.

Documents scored as toxic go, one document of each group of near-duplicates stays,
documents with benchmark items go, the rest is mixed to target weights, and the mix is
assigned to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velum.llm.decontaminate import drop_contaminated
from velum.llm.mixing import mix
from velum.llm.near_dedup import keep_one
from velum.llm.queries import SHARD_BYTES
from velum.llm.shared import Scratch
from velum.llm.sharding import extendible_shards
from velum.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that score 0.5 or more; the classifier is fitted to the
    table's own labels."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter("toxicity < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights; some leave, some repeat."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they belong to."""
    return extendible_shards(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# The classifier's scores, the samples and the draws of the mix are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
