"""Texts and spans stored in one layout, so that they meet again without being moved.

All tables of a store are bucketed by ``doc_id`` into the same number of buckets, one file a
bucket, and sorted inside it. ``remask(store["texts"], store["spans"], config)`` and
``deidentify(..., model_spans=store["spans"])`` then need no exchange: a task reads the
buckets of the same number of both tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text of a bucket where the number of buckets is not given, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 100_000


def buckets_for(documents: DataFrame) -> int:
    """A number of buckets for texts, by their length."""
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, min(MOST_BUCKETS, -(-total // BUCKET_BYTES)))


def write_store(path: str, texts: DataFrame, buckets: int | None = None, **tables: DataFrame) -> None:
    """Write ``texts`` (``doc_id, text``) and other tables with a ``doc_id`` of the same type
    below ``path``, which must be new. Rows without ``doc_id`` are stored too."""
    buckets = buckets or buckets_for(texts)
    tables = {"texts": texts, **tables}
    kinds = {name: df.schema["doc_id"].dataType for name, df in tables.items()}
    if len(set(kinds.values())) > 1:
        raise ValueError(f"doc_id has different types: {kinds}")
    for name, df in tables.items():
        order = ["doc_id", "start"] if "start" in df.columns else ["doc_id"]
        table = f"velum_{uuid.uuid4().hex}"
        # Dealt out as the writer buckets, so that each task writes one file.
        df.repartition(buckets, "doc_id").write.format("parquet").bucketBy(buckets, "doc_id").sortBy(
            *order
        ).option("path", f"{path}/{name}").saveAsTable(table)
        df.sparkSession.sql(f"DROP TABLE {table}")
    layout = [(name, buckets, df.schema.json()) for name, df in tables.items()]
    spark = texts.sparkSession
    # Last, so that a store with a layout is whole.
    spark.createDataFrame(layout, "name string, buckets int, schema string").coalesce(1).write.json(f"{path}/_layout")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a store by name, as this session knows their layout."""
    layout = spark.read.schema("name string, buckets int, schema string").json(f"{path}/_layout")
    return {row["name"]: _bucketed(spark, f"{path}/{row['name']}", row) for row in layout.collect()}


def _bucketed(spark: SparkSession, path: str, layout) -> DataFrame:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])))
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    table = f"velum_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY (doc_id) INTO {layout['buckets']} BUCKETS LOCATION '{where}'"
    )
    return spark.table(table)
