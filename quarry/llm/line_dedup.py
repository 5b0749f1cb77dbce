"""Line dedup by content-defined line chunks.

A document's lines are hashed; a rolling hash over ``WINDOW`` line hashes
ends a chunk after a line where it is 0 modulo ``MEAN``, so boundaries
depend on nearby lines only and shift with them.  Chunks of two lines or more that occur at
more than one place, anywhere, keep their first occurrence (smallest
document key, then position) and lose the others, after their bytes were
compared.  Everything is DataFrame expressions.

First only chunk hashes are counted; the texts of chunks whose hash repeats
are then grouped by their bytes, with map-side combining, so a chunk that a
third of all documents share costs one row a task.  The marks meet the
documents in a join that adaptive execution can split.

Defined cases: a null or empty text has no lines and stays as it is; rows
equal in every column are one place and are treated alike; single-line
chunks are never removed; extra columns, of any name not starting with an
underscore, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.chat import pin
from quarry.llm.io import staged

WINDOW, MEAN = 2, 4


def _chunked(df: DataFrame, text: str, window: int, mean: int) -> DataFrame:
    """``df`` with _lines and _ends (last line of every chunk, counted from 0)."""
    lines = F.when(F.length(F.col(text)) > 0, F.split(F.col(text), "\n")).otherwise(F.array().cast("array<string>"))
    df = pin(df, _lines=lines)
    df = pin(df, _hashes=F.transform("_lines", lambda x: F.xxhash64(x)))
    n = F.size("_lines")
    rolled = lambda i: F.xxhash64(*[F.coalesce(F.get(F.col("_hashes"), i - j), F.lit(0)) for j in range(window)])
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return pin(df, _ends=F.filter(every, lambda i: (i == n - 1) | (F.pmod(rolled(i), F.lit(mean)) == 0)))


def _bounds() -> Column:
    """Chunks as (number, first line, lines)."""
    first = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("_ends"), i - 1) + 1)
    return F.transform("_ends", lambda e, i: F.struct(i.alias("c"), first(i).alias("a"), (e - first(i) + 1).alias("n")))


def _text_of(a: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.col("_lines"), a + 1, n), "\n")


def _row_key(documents: DataFrame) -> Column:
    """Equal rows share it: two 64-bit hashes from different seeds, as one binary value (a plain join key)."""
    hashes = F.xxhash64(*documents.columns), F.xxhash64(F.lit(8), *documents.columns)
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in hashes]))


def repeated_chunks(documents: DataFrame, text: str = "text", window: int = WINDOW, mean: int = MEAN) -> DataFrame:
    """Chunks to remove: _key (of the row), chunks (their numbers)."""
    keyed = documents.select(_row_key(documents).alias("_key"), F.col(text).alias("_text"))
    chunks = _chunked(keyed, "_text", window, mean).select("_key", "_lines", F.explode(_bounds()).alias("x")).filter("x.n > 1")
    hashes = staged(chunks.select("_key", F.col("x.c").alias("c"), F.xxhash64(_text_of(F.col("x.a"), F.col("x.n"))).alias("h")),
                    "line-chunks")
    place = F.struct("_key", "c")
    repeated = hashes.groupBy("h").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p != q").select("h")
    maybe = hashes.join(repeated, "h").groupBy(F.col("_key").alias("_k")).agg(F.collect_set("c").alias("_maybe"))
    # byte comparison: group the candidate chunks by their whole text
    texts = (_chunked(keyed.dropDuplicates(["_key"]).join(maybe, F.col("_key") == F.col("_k")), "_text", window, mean)
             .select("_key", "_lines", F.explode(F.filter(_bounds(), lambda x: F.array_contains("_maybe", x["c"]))).alias("x"))
             .select("_key", F.col("x.c").alias("c"), _text_of(F.col("x.a"), F.col("x.n")).alias("t")))
    texts = staged(texts, "line-chunk-texts")
    first = texts.groupBy(F.col("t").alias("_t")).agg(F.min(place).alias("p"), F.count("*").alias("m")).filter("m > 1")
    return (texts.join(first, F.col("t") == F.col("_t")).filter(F.struct("_key", "c") != F.col("p"))
            .groupBy("_key").agg(F.collect_set("c").alias("_chunks")))


def dedup_lines(documents: DataFrame, text: str = "text", window: int = WINDOW, mean: int = MEAN) -> DataFrame:
    """``documents`` without their repeated chunks: ``text`` is cleaned, and _n_lines, _n_chunks and
    _removed (lines taken out) are added."""
    marks = repeated_chunks(documents, text, window, mean).withColumnRenamed("_key", "_of")
    df = documents.withColumn("_key", _row_key(documents)).join(marks, F.col("_key") == F.col("_of"), "left")
    df = _chunked(df, text, window, mean)
    gone = F.coalesce("_chunks", F.array().cast("array<int>"))
    df = pin(df, _kept=F.filter(_bounds(), lambda x: ~F.array_contains(gone, x["c"])))
    left = F.aggregate("_kept", F.lit(0), lambda n, x: n + x["n"])
    cleaned = F.when(F.size(gone) == 0, F.col(text)).otherwise(
        F.array_join(F.transform("_kept", lambda x: _text_of(x["a"], x["n"])), "\n"))
    others = [c for c in documents.columns if c != text]
    return df.select(*others, cleaned.alias(text), F.size("_lines").cast("long").alias("_n_lines"),
                     F.size("_ends").cast("long").alias("_n_chunks"), (F.size("_lines") - left).cast("long").alias("_removed"))


def op8_line_dedup(spark, sf_dir) -> DataFrame:
    """What remains of every document without repeated line chunks."""
    from quarry.llm.io import read

    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_chunks").alias("n_chunks"),
                      F.col("_removed").alias("n_removed_lines"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
