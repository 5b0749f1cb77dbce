"""The base of a store: rows of settled batches in hash buckets of ``file_path``, rewritten a bucket at a time.

Layout, next to the batch logs::

    base/<table>/gen=G/bucket=B/   rows of the bucket as generation G wrote them
    base/commits/gen=G/            written last: G's parent, the batches it settled, the buckets it rewrote

A generation rewrites the buckets that new batches touch and leaves the others
where earlier generations put them, so a compaction costs what has changed, not
what is stored.  Every generation names the one it was built on.  Readers follow
this chain from the start; of several built on the same one (two compactions
at once) the smallest name counts and the others are as if never written.
Nothing is deleted: an open reader goes on reading what it saw.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "parent string, buckets int, settled long, bucket int"


@dataclass
class Base:
    """``held``: generation -> the buckets whose rows it holds; ``settled``: the batches inside the base."""
    newest: str = ""
    buckets: int = 0
    settled: set = field(default_factory=set)
    held: dict = field(default_factory=dict)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")


def open_base(spark: SparkSession, store: str) -> Base:
    """The chain of committed generations (a row for each settled batch and rewritten bucket, as many as there are folders)."""
    try:
        rows = spark.read.schema(f"{_COMMIT}, gen string").parquet(f"{store.rstrip('/')}/base/commits").collect()
    except AnalysisException:                            # never compacted in place
        return Base()
    built_on: dict[str, str] = {}
    for r in rows:
        built_on[r.parent] = min(r.gen, built_on.get(r.parent, r.gen))
    base, newest_of = Base(), {}
    while base.newest in built_on:
        base.newest = built_on[base.newest]
        for r in rows:
            if r.gen == base.newest:
                base.buckets = r.buckets
                if r.bucket is None:
                    base.settled.add(r.settled)
                else:
                    newest_of[r.bucket] = r.gen
    for bucket, gen in sorted(newest_of.items()):
        base.held.setdefault(gen, []).append(bucket)
    return base


def base_rows(spark: SparkSession, store: str, table: str, schema: str, base: Base, only: list[int] | None = None) -> DataFrame:
    """A table's rows in the base, of the buckets ``only`` if given.  The filter is on the partition columns, so
    folders of superseded buckets are not read."""
    held = {gen: [b for b in buckets if only is None or b in set(only)] for gen, buckets in base.held.items()}
    current = [(F.col("gen") == gen) & F.col("bucket").isin(buckets) for gen, buckets in held.items() if buckets]
    schema = f"{schema}, gen string, bucket int"
    try:
        rows = spark.read.schema(schema).parquet(f"{store.rstrip('/')}/base/{table}")
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    return rows.filter(reduce(lambda a, b: a | b, current, F.lit(False))).drop("gen", "bucket")


def write_rows(df: DataFrame, store: str, table: str, gen: str, buckets: int) -> None:
    """Rows by bucket and path: a bucket above the usual task is cut by path, and files carry narrow min/max of paths."""
    df.withColumn("bucket", bucket_of(buckets)).repartitionByRange("bucket", "file_path").sortWithinPartitions("bucket", "file_path") \
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{store.rstrip('/')}/base/{table}/gen={gen}")


def commit(spark: SparkSession, store: str, gen: str, base: Base, buckets: int, settled: list[int], touched: list[int]) -> None:
    rows = [(base.newest, buckets, b, None) for b in settled] + [(base.newest, buckets, None, b) for b in touched]
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{store.rstrip('/')}/base/commits/gen={gen}")
