"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. On one machine, where a
    session may have none, a temporary folder is made and set for the session; on a
    cluster each executor would write to its own disk, so that raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="velum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder. A written table cuts the lineage: a lost
    executor costs the tasks of one step, and no step runs twice."""

    #: Bytes of a batch that goes to Python, where the session has no setting of its own.
    BATCH = "8m"

    #: Rows of some MB each are written in row groups of about 16 MB: a writer holds a row group
    #: and looks at its size after each row, and Spark's reader decodes one whole.
    LARGE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, self.BATCH)
        self.root = f"{shared_folder(spark)}/velum/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` and read it back; then let go of the shuffle files behind it."""
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        del df
        self.release()
        return kept

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        """Delete all tables of the run; what was read from them is gone with them."""
        self.drop("")

    def release(self) -> None:
        """Shuffle files stay on disk until the driver collects the objects of their
        plans; between steps of a long run that would add up to a multiple of the data."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on between tasks and
    stages, and an allocator that keeps its largest need would add up over them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fraction(*values: Column) -> Column:
    """A number from [0, 1) drawn from the hash of ``values``."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11) / F.lit(float(1 << 53))


def offsets(counts: DataFrame, index: str, n: str, block: int = 1024) -> DataFrame:
    """``index, offset``: the sum of ``n`` over all smaller values of the distinct
    ``index``. Sums run inside blocks of indexes and over the sums of blocks, so the only
    sort in one place is over a thousandth of the rows."""
    part = F.expr(f"{index} div {block}")
    marked = counts.select(F.col(index), F.col(n).alias("_n"), part.alias("_block"))
    above = marked.groupBy("_block").agg(F.sum("_n").alias("_n"))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_above"))
    within = Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("_inside", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return inside.join(above, "_block").select(
        index, (F.col("_above") + F.col("_inside")).cast("long").alias("offset")
    )
