"""Small helpers shared by the operators: tables, staging and the package on the workers."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session
from quarry.session import materialize, table

__all__ = ["give_back", "gives_back", "materialize", "read", "release", "ship_package", "staged", "utf8_bytes"]

ARROW_BYTES = 4 << 20        # whole texts go to Python in batches of about this size


def ship_package(spark: SparkSession) -> None:
    """The package on the workers, and Arrow batches bounded by bytes: rows hold whole
    texts, so a bound on their number alone would let a task's buffers grow with them."""
    session.ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the package travels to the workers first."""
    ship_package(spark)
    return table(spark, sf_dir, name)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: cuts the
    lineage, survives lost executors and is not computed twice."""
    return materialize(df, label)


def release(df: DataFrame) -> None:
    """Delete a staged table that no later step reads (only a folder that ``staged`` wrote)."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("quarry-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8_bytes(col):
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def give_back() -> None:
    """What this process has freed goes back to the system: a Python worker waits for its
    next task next to the JVM, and both allocators would keep its last task's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def gives_back(run):
    """A function over a task's batches that gives its memory back when the task ends."""
    @wraps(run)
    def task(batches, *args, **kwargs):
        try:
            yield from run(batches, *args, **kwargs)
        finally:
            give_back()
    return task
