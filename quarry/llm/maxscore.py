"""Exact top-k by integer inner product: MaxScore over shards of vectors.

Each component of a vector is a term.  In a shard, a term adds at least ``low``
and at most ``high`` to a query's score; ``high - low`` is its bound, and scores
are counted from the sum of all ``low``.  Terms are ordered by bound.  The
non-essential ones are as many of the smallest as together stay below the
threshold: a vector that gains from them alone cannot be among the k best.  The
others are essential and traversed in full; of what they leave competitive
(partial score plus the bounds still missing reaches the threshold) the
non-essential terms are probed, largest first, and what falls behind is dropped
after every few.  Vectors come in blocks, and with every block the threshold
rises to the k-th score so far and the split is made anew.

The threshold is carried between shards: a first pass scores all queries
against one sample of about ``FIRST`` vectors, whose k-th score no final one is
below, and every shard starts from it.  A shard therefore mostly returns the
few vectors that can still win, and the last cut is a grouped rank limit.
Nothing is approximate: a pruned vector's score is provably below k others.

Shards and blocks of queries meet in a grid whose cells hold about
``CELL_BYTES`` of each; cells are smaller only to give every core one.  Equal
rows travel as one with their number, so no cell grows with a repeated row.

Defined cases: null vectors and vectors with a null or non-finite component
take no part; a null id takes no part as a query, and ranks last among equal
scores as a candidate; of equal ids, all rows take part and only rows of the
query's own id are left out; equal rows among the queries are one query, and
other vectors of the same id are queries of their own; vectors of other lengths
are padded with zeros (their scores ignore the missing terms); an empty table
gives no rows.  Scores must fit a 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.io import read, staged

CELL_BYTES, FIRST, LEAST = 32 << 20, 4096, 2048
STEP, ROWS = 8, 2048    # terms probed between two prunings, vectors between two splits
_NONE = np.iinfo(np.int64).max
_FOUND = "query_id long, query_key long, vec_id long, copies long, score long"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """(width, rows) integers of an array<long> column, short rows padded with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int64)
    if len(values):
        out[np.arange(width)[None, :] < n[:, None]] = values
    return np.ascontiguousarray(out.T)


class Shard:
    """Vectors of a shard by term, with the extremes of every term."""

    def __init__(self, terms: np.ndarray, ids: np.ndarray):
        self.ids = ids
        self.least, self.most = (terms.min(1), terms.max(1)) if terms.shape[1] else (terms[:, :0].sum(1),) * 2
        self.blocks = [terms[:, a:a + ROWS] for a in range(0, terms.shape[1], ROWS)]

    def top_k(self, query: np.ndarray, own: int | None, k: int, theta=None) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, components read) of the k best vectors by score and then smaller id; of those
        below ``theta``, which k vectors elsewhere are known to reach, none need be among them."""
        ends = np.stack([query * self.least, query * self.most])
        low, bound = ends.min(0), ends.max(0) - ends.min(0)
        order = np.argsort(bound, kind="stable")
        missing = np.concatenate([[0], np.cumsum(bound[order])])        # missing[i]: bounds of the i smallest terms
        rows, scores, touched = np.zeros(0, np.int64), query[:0], 0
        for at, block in enumerate(self.blocks):
            split = 0 if theta is None else max(0, int(np.searchsorted(missing, theta - low.sum(), "left")) - 1)
            essential = order[split:]
            score = query[essential] @ block[essential] + low[order[:split]].sum()
            touched += len(essential) * block.shape[1]
            live = np.arange(block.shape[1])
            if own is not None:
                other = self.ids[at * ROWS:at * ROWS + len(live)] != own
                live, score = live[other], score[other]
            while True:
                if theta is not None:
                    keep = score + missing[split] >= theta
                    live, score = live[keep], score[keep]
                if not split or not len(live):
                    break
                probed = order[max(0, split - STEP):split]
                score = score + (query[probed] @ block[np.ix_(probed, live)] - low[probed].sum())
                touched += len(probed) * len(live)
                split -= len(probed)
            if len(live):
                rows, scores = np.concatenate([rows, live + at * ROWS]), np.concatenate([scores, score])
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
                if len(rows) == k and (theta is None or scores[-1] > theta):
                    theta = scores[-1]
        return rows, scores, touched


def _cell(k: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_key": [], "vec_id": [], "copies": [], "score": []}
        if shard.num_rows and queries.num_rows:
            width = max(int(np.diff(np.asarray(t["v"].combine_chunks().offsets)).max()) for t in (shard, queries))
            terms, q = _matrix(shard["v"], width), _matrix(queries["v"], width).T
            largest = width * int(np.abs(terms).max(initial=0)) * int(np.abs(q).max(initial=0))
            if largest < 1 << 52:                       # sums are exact as doubles too, and those multiply faster
                terms, q = terms.astype(np.float64), q.astype(np.float64)
            raw = shard["id"].combine_chunks()
            vec_ids, copies = raw.to_pylist(), shard["copies"].to_pylist()
            held = Shard(terms, raw.fill_null(_NONE).to_numpy(zero_copy_only=False))
            for own, key, theta, vector in zip(*(queries[c].to_pylist() for c in ("id", "key", "theta")), q):
                rows, scores, _ = held.top_k(vector, own, k, theta)
                out["query_id"] += [own] * len(rows)
                out["query_key"] += [key] * len(rows)
                out["vec_id"] += [vec_ids[r] for r in rows]
                out["copies"] += [copies[r] for r in rows]
                out["score"] += [int(s) for s in scores]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return run


def _place(n: int) -> Column:
    return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")


def _grid(vectors: DataFrame, queries: DataFrame, n_shards: int, n_blocks: int, k: int) -> DataFrame:
    """k rows at most per query and shard: every shard of ``vectors`` meets every block of ``queries``."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("id", "v", "copies", _place(n_shards).alias("s")).select("*", every(n_blocks).alias("b"))
    right = queries.select("id", "key", "v", "theta", _place(n_blocks).alias("b")).select("*", every(n_shards).alias("s"))
    return left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(_cell(k), _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int | None = None, block: int | None = None,
          first: int = FIRST) -> DataFrame:
    """The k best ``vectors`` (id, v array<long>) of every query (id, v): query_id, rank, vec_id, score.
    ``shard`` and ``block`` are vectors and queries a cell (by default as ``CELL_BYTES`` allow)."""
    held = staged(vectors.groupBy("id", "v").agg(F.count("*").alias("copies")), "top-vectors")
    asked = staged(queries.filter("id is not null").select("id", "v").distinct()
                   .select("id", "v", F.xxhash64("v").alias("key"), F.lit(None).cast("long").alias("theta")), "top-queries")
    size = held.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n_queries, cores = asked.count(), vectors.sparkSession.sparkContext.defaultParallelism
    fits = max(1, CELL_BYTES // (8 * max(1, size.width or 1)))
    n_shards = -(-size.n // shard) if shard else max(-(-size.n // fits), min(cores, size.n // LEAST))
    n_shards, n_blocks = max(1, n_shards), max(1, -(-n_queries // (block or fits)))

    sample = held.filter(_place(max(1, size.n // first)) == 0)
    known = _grid(sample, asked, 1, max(n_blocks, min(cores, n_queries // LEAST)), k)
    theta = known.groupBy("query_id", "query_key").agg(F.min("score").alias("score"), F.count("*").alias("n")) \
        .filter(F.col("n") == k).select("query_id", "query_key", F.col("score").alias("theta"))
    started = asked.drop("theta").join(
        theta, (F.col("id") == F.col("query_id")) & (F.col("key") == F.col("query_key")), "left")
    started = staged(started.select("id", "key", "v", "theta"), "top-thresholds")

    found = _grid(held, started, n_shards, n_blocks, k)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def quantised(embedding: str) -> Column:
    """floor(256 x) of every component, as longs."""
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(embedding: str) -> Column:
    ok = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(embedding).isNotNull() & F.coalesce(ok, F.lit(False))


def op6_maxscore_topk(spark, sf_dir) -> DataFrame:
    """Top 5 of all vectors for every vec_id divisible by 50."""
    v = (read(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(usable("embedding"))
         .select(F.col("vec_id").alias("id"), quantised("embedding").alias("v")))
    return top_k(v, v.filter(F.col("id") % 50 == 0), 5)
