"""Sharding by sampled splitters: near equal bytes per shard.

Records are ordered by a composite key (hash of the text, hash of the other
columns, a row tie-break), so equal texts lie next to each other and share a
shard unless their group is larger than what a shard can hold.  A sample
weighted by size (about ``SAMPLES`` keys per range, so its bound is a
parameter and not the data) gives quantile boundaries; records are
range-partitioned by them, the ranges' exact bytes are measured, and ranges
over ``OVERFULL`` times the mean are subdivided by new samples of their own
until none is, or it holds one record (or no new sample finds a place to cut
between two different keys).  The exact running bytes then cut the order into
shards, so shards differ by about one record, or by such a group.

Defined cases: a null text has no bytes (size 1 with the row's own byte),
text_crc32 0 like the empty text; repeated rows are separate records told
apart by a tie-break, and as they are equal, which of them goes where does
not show; an empty table gives no rows; fewer records than shards leave shards empty.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.io import give_back, staged, utf8_bytes

SHARDS = 16
ROWS_PER_RANGE, MIN_RANGES, MAX_RANGES, SAMPLES, OVERFULL, WHOLE = 50_000, 64, 65_536, 24, 4.0, 0.1


def _key_bytes(*parts) -> np.ndarray:
    """Fixed-width big-endian byte strings that sort like the tuples of signed longs."""
    out = np.empty((len(parts[0]), len(parts)), ">u8")
    for i, p in enumerate(parts):
        out[:, i] = np.asarray(p, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(parts)}").ravel()


def _range_of(splitters: np.ndarray):
    """Arrow UDF: number of splitters at or below a key."""
    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        keys = _key_bytes(*(x.to_numpy(zero_copy_only=False) for x in (a, b, c)))
        found = pa.array(np.searchsorted(splitters, keys, "right").astype(np.int32))
        del keys
        give_back()
        return found
    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")


def _sample(rows: DataFrame, share_of: float, label: int) -> np.ndarray:
    """Keys drawn with probability size * share_of (at most 1), by hash, so reruns agree."""
    draw = F.pmod(F.xxhash64("_k1", "_k2", "_k3", F.lit(label)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.filter(draw < F.col("_size") * share_of).select("_k1", "_k2", "_k3").toPandas()
    return _key_bytes(drawn["_k1"], drawn["_k2"], drawn["_k3"])


def _quantiles(sample: np.ndarray, n: int) -> np.ndarray:
    s = np.sort(sample)
    if len(s) == 0 or n < 2:
        return s[:0]
    return np.unique(s[(np.arange(1, n) * len(s)) // n])


def splitters_for(rows: DataFrame, total: int, count: int) -> tuple[np.ndarray, dict]:
    """Splitters of ranges that hold similar bytes, and range -> (bytes, records)."""
    n = int(min(MAX_RANGES, max(MIN_RANGES, count // ROWS_PER_RANGE)))
    cuts = _quantiles(_sample(rows, n * SAMPLES / max(1, total), 0), n)
    for attempt in itertools.count(1):
        ranged = rows.withColumn("_r", _range_of(cuts)("_k1", "_k2", "_k3"))
        held = {r._r: (r.b, r.n) for r in ranged.groupBy("_r").agg(
            F.sum("_size").alias("b"), F.count("*").alias("n")).collect()}
        over = [r for r, (b, c) in held.items() if b > OVERFULL * total / n and c > 1]
        if not over:
            return cuts, held
        inside = _sample(ranged.filter(F.col("_r").isin(over)), n * SAMPLES * 2 / max(1, total), attempt)
        where = np.searchsorted(cuts, inside, "right")
        new = [_quantiles(inside[where == r], int(2 * held[r][0] * n // max(1, total)) + 2) for r in over]
        grown = np.unique(np.concatenate([cuts, *new]))
        if len(grown) == len(cuts):
            return cuts, held
        cuts = grown


def _whole_groups(cut: DataFrame, most: float) -> dict[int, int]:
    """Text hash -> shard of the groups that the ends of shards cut, if they have at most ``most`` bytes."""
    ends = sorted((r._shard, r.low, r.high) for r in cut.groupBy("_shard").agg(
        F.min("_k1").alias("low"), F.max("_k1").alias("high")).collect())                 # one row a shard
    split = {a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]}
    held: dict[int, dict] = {}
    if split:
        for r in cut.filter(F.col("_k1").isin(split)).groupBy("_k1", "_shard").agg(F.sum("_size").alias("b")).collect():
            held.setdefault(r._k1, {})[r._shard] = r.b
    return {k: min(h, key=lambda s: (-h[s], s)) for k, h in held.items() if sum(h.values()) <= most}


def shard(records: DataFrame, shards: int = SHARDS, text: str = "text", keep=("doc_id",), payload=()) -> DataFrame:
    """Every record with size, text_crc32, law ('bytes'), shard and slot; columns ``keep`` stay.

    ``payload`` names further columns to carry along (the text itself, if the
    shards are to be written); the splitting works on keys alone otherwise.
    """
    others = [c for c in records.columns if c != text]
    rows = records.select(
        *[F.col(c) for c in dict.fromkeys([*keep, *payload])],
        (utf8_bytes(F.col(text)) + 1).alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        F.xxhash64(text).alias("_k1"), F.xxhash64(*others).alias("_k2"), F.monotonically_increasing_id().alias("_k3"))
    rows = staged(rows, "shard-keys")
    known = rows.agg(F.count("*").alias("n"), F.sum("_size").alias("b")).first()
    count, total = known.n, known.b or 0
    cuts, held = splitters_for(rows, total, count)
    spark = records.sparkSession
    before, table = 0, []
    for r in sorted(held):
        table.append((int(r), int(before)))
        before += held[r][0]
    offsets = spark.createDataFrame(table, "_of int, _before long")      # one row a range, at most a few times MAX_RANGES
    ranged = rows.withColumn("_r", _range_of(cuts)("_k1", "_k2", "_k3")).join(
        F.broadcast(offsets), F.col("_r") == F.col("_of"))
    order = Window.partitionBy("_r").orderBy("_k1", "_k2", "_k3")
    upto = F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = F.floor((upto - F.col("_size") / 2) * F.lit(float(shards)) / F.lit(float(max(1, total))))
    cut = staged(ranged.withColumn("_shard", F.least(place, F.lit(shards - 1)).cast("int")), "shards-cut")
    whole = _whole_groups(cut, WHOLE * total / shards)
    to = F.col("_shard")
    for key, target in whole.items():
        to = F.when(F.col("_k1") == key, F.lit(target)).otherwise(to)
    placed = staged(cut.withColumn("_shard", to)
                    .withColumn("_in", F.row_number().over(
                        Window.partitionBy("_r", "_shard").orderBy("_k1", "_k2", "_k3"))), "shards")
    per = sorted((r._shard, r._r, r.n) for r in placed.groupBy("_shard", "_r").agg(F.count("*").alias("n")).collect())
    starts, run = [], {}
    for s, r, n in per:
        starts.append((int(s), int(r), int(run.get(s, 0))))
        run[s] = run.get(s, 0) + n
    starts = spark.createDataFrame(starts, "_s int, _q int, _start long")
    return (placed.join(F.broadcast(starts), (F.col("_shard") == F.col("_s")) & (F.col("_r") == F.col("_q")))
            .select(*[F.col(c) for c in keep], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                    F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
                    (F.col("_start") + F.col("_in") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"),
                    *[F.col(c) for c in payload if c not in keep]))


def op2_sharding(spark, sf_dir) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    from quarry.llm.io import read

    return shard(read(spark, sf_dir, "documents"))
