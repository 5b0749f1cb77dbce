"""Vector retrieval (K1 cosine distance, K2 exact top-k, K3 approximate top-k
with an inverted-file layout, J4 request x vector scoring, F5 file filter).

Exact top-k never materialises (query, vector) pairs as rows:

* **broadcast strategy** (query matrix within ``max_broadcast_bytes``): the
  vectors are scanned once, in place; each task scores its Arrow batches
  against tiles of the broadcast query matrix and keeps, per query and batch,
  only the ``k`` best rows (ties kept exactly, then cut by id).
* **blocked strategy** (bigger request sets): vectors and queries are hashed
  into blocks; ``cogroup`` on ``(vector block, query block)`` hands each task a
  bounded slice of both, scored the same way.  Each vector is replicated once
  per query block and each query once per vector block, sizes chosen from the
  counts, so no group grows with the data.

Either way at most ``k`` candidates per query and Arrow batch (or block)
leave the kernel, the group limit cuts them to the largest ``k`` per query and
task before the shuffle, and a final ``row_number() <= k`` (planned as
WindowGroupLimit) picks the global top-k.  Order: distance ascending, NULL last, then vector id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import patterns as P
from quarry.session import materialize

TILE_CELLS = 1 << 22          # distances of one tile in the kernel
TILE_ROWS = 1 << 11           # queries of one tile
PAIRS = 1 << 16               # pairs computed in double at a time
BLOCK_BYTES = 16 << 20        # doubles of either side of a block of vectors and queries
SCAN_CELLS = 1 << 29          # distances one task of a scan computes
RECALL_SAMPLE = 256           # queries on which K3's recall is measured

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("vector_id", T.StringType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("k", T.IntegerType()),
])


def cosine_distance(a: Column, b: Column) -> Column:
    """K1: ``1 - a.b / (|a| |b|)`` in double; NULL when either norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, v: acc + v)
    na = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.lit(1.0) - F.try_divide(dot, F.sqrt(na) * F.sqrt(nb))


def _cut(row, col, dist, id_rank, ks):
    """Per query, the best ``ks`` of its (row, column, distance) by distance, NaN (NULL) last, then by id."""
    import numpy as np

    by = np.lexsort((id_rank[col], np.where(np.isnan(dist), np.inf, dist), row))
    row, col, dist = row[by], col[by], dist[by]
    best = np.arange(len(row)) - np.searchsorted(row, row) < ks[row]
    return row[best], col[best], dist[best]


def _exact(q_mat, v_mat, qn, vn, row, col):
    """Cosine distances of single pairs, each summed the same way wherever its rows lie (a blocked
    product can round two identical vectors differently, which would break ties that the id decides)."""
    import numpy as np

    dist = np.empty(len(row))
    for a in range(0, len(row), PAIRS):
        r, c = row[a:a + PAIRS], col[a:a + PAIRS]
        with np.errstate(all="ignore"):
            dist[a:a + PAIRS] = 1.0 - np.einsum("id,id->i", q_mat[r], v_mat[c]) / (qn[r] * vn[c])
    dist[~np.isfinite(dist)] = np.nan          # a zero vector: NULL distance
    return dist


def _nearest(q_mat, v_mat, id_rank, ks):
    """Exact best ``ks`` columns of every row, as (row, column, distance) arrays a tile of rows at a time.

    A single-precision product of unit vectors picks, per query, what can be
    among its best (``margin`` is twice its largest error); only those pairs
    are computed in double.  The bound falls from tile to tile of the vectors,
    so few pairs pass.  Zero vectors have NULL distances and come last, by id;
    rows whose norm is not of an ordinary size are compared with everything.
    """
    import numpy as np

    if not len(v_mat) or not len(q_mat) or ks.max() <= 0:
        return
    if q_mat.shape[1] != v_mat.shape[1]:
        raise ValueError(f"query vectors have {q_mat.shape[1]} dimensions, stored vectors {v_mat.shape[1]}")
    k = min(int(ks.max()), len(v_mat))
    with np.errstate(all="ignore"):
        qn, vn = (np.sqrt(np.einsum("ad,ad->a", m, m)) for m in (q_mat, v_mat))
    usual = lambda n: (n >= 1e-100) & (n <= 1e100)
    first = np.argsort(id_rank, kind="stable")
    odd = np.flatnonzero(~usual(vn) & (vn != 0))
    some = np.flatnonzero(usual(vn))
    more = first[vn[first] == 0][:k] if len(some) < k else first[:0]
    vu = (v_mat[some] / vn[some, None]).astype(np.float32)
    margin = np.float32(1.2e-7 * (q_mat.shape[1] + 8))
    for at in range(0, len(q_mat), TILE_ROWS):
        qm, n, asked = q_mat[at:at + TILE_ROWS], qn[at:at + TILE_ROWS], ks[at:at + TILE_ROWS]
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

        def settle(row, col, dist=None):
            dist = _exact(qm, v_mat, n, vn, row, col) if dist is None else dist
            kept[0] = _cut(*(np.concatenate(x) for x in zip(kept[0], (row, col, dist))), id_rank, asked)

        none = np.flatnonzero(n == 0)
        settle(np.repeat(none, k), np.tile(first[:k], len(none)), np.full(len(none) * k, np.nan))
        for r in np.flatnonzero(~usual(n) & (n != 0)):
            settle(np.full(len(v_mat), r), np.arange(len(v_mat)))
        plain = np.flatnonzero(usual(n))
        for c in np.array_split(np.concatenate([odd, more]), math.ceil((len(odd) + len(more)) * TILE_ROWS / TILE_CELLS) or 1):
            settle(np.repeat(plain, len(c)), np.tile(c, len(plain)))
        qu = (qm[plain] / -n[plain, None]).astype(np.float32)        # the far ones have the large products
        bound = np.full(len(plain), np.inf, np.float32)
        row, col, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        width = max(1, TILE_CELLS // TILE_ROWS)
        for v in range(0, len(some), width):
            tile = qu @ vu[v:v + width].T
            if v == 0 and tile.shape[1] > k:
                bound = np.partition(tile, k - 1, axis=1)[:, k - 1]
            r, c = np.divmod(np.flatnonzero(tile <= (bound + margin)[:, None]), tile.shape[1])
            row, col, far = (np.concatenate(x) for x in ((row, r), (col, c + v), (far, tile[r, c])))
            by = np.lexsort((far, row))
            row, col, far = row[by], col[by], far[by]
            kth = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
            bound[row[kth]] = np.minimum(bound[row[kth]], far[kth])
            near = far <= bound[row] + margin
            row, col, far = row[near], col[near], far[near]
            if len(row) > TILE_CELLS // 4:         # many (nearly) equal vectors: decided at once
                settle(plain[row], some[col])
                row, col, far = row[:0], col[:0], far[:0]
        settle(plain[row], some[col])
        yield kept[0][0] + at, *kept[0][1:]


def _scopes(filters, paths):
    """(queries, vectors) places that belong together: those without a file filter and all, then a file's."""
    import numpy as np

    free = np.array([i for i, f in enumerate(filters) if f is None], dtype=np.int64)
    if len(free):
        yield free, np.arange(len(paths))
    if len(free) == len(filters):
        return
    by_path: dict[str, tuple[list, list]] = {}
    for i, f in enumerate(filters):
        if f is not None:
            by_path.setdefault(f, ([], []))[0].append(i)
    for j, path in enumerate(paths):
        if path in by_path:
            by_path[path][1].append(j)
    for q, v in by_path.values():
        if v:
            yield np.asarray(q, dtype=np.int64), np.asarray(v, dtype=np.int64)


def _id_rank(ids):
    import numpy as np

    return np.argsort(np.argsort(ids, kind="stable"), kind="stable")


def _local_topk(q_ids, q_mat, q_filters, q_ks, vec_ids, vec_paths, v_mat):
    """Frames of the best ``k`` hits of every query among one slice of vectors.

    Queries with a file filter are scored only against that file's vectors of
    the slice, the others against the whole slice.
    """
    import numpy as np

    ids = np.asarray(vec_ids, dtype=object)
    id_rank = _id_rank(ids)
    q_ids, q_ks = np.asarray(q_ids, dtype=np.int64), np.asarray(q_ks, dtype=np.int64)
    for qi, vi in _scopes(q_filters, vec_paths):
        for row, col, dist in _nearest(q_mat[qi], v_mat[vi], id_rank[vi], q_ks[qi]):
            if len(row):
                yield _hit_frame(q_ids[qi[row]], ids[vi[col]], dist, q_ks[qi[row]])


def _listed_topk(q_ids, q_mat, q_filters, q_ks, lists_of, vec_ids, vec_paths, vec_lists, v_mat):
    """A frame of the best ``k`` hits of every query among the vectors of the lists it probes.

    ``lists_of(list_id)``: places of the queries that probe it.
    """
    import numpy as np

    ids, vec_paths = np.asarray(vec_ids, dtype=object), np.asarray(vec_paths, dtype=object)
    id_rank, filters = _id_rank(ids), np.asarray(q_filters, dtype=object)
    q_ids, q_ks = np.asarray(q_ids, dtype=np.int64), np.asarray(q_ks, dtype=np.int64)
    by = np.argsort(vec_lists, kind="stable")
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    held, size = [kept], 0
    for run in np.split(by, np.flatnonzero(np.diff(vec_lists[by])) + 1):
        mine = lists_of(vec_lists[run[0]]) if len(run) else run
        for qi, vi in _scopes(filters[mine], vec_paths[run]):
            qi, vi = mine[qi], run[vi]
            for row, col, dist in _nearest(q_mat[qi], v_mat[vi], id_rank[vi], q_ks[qi]):
                held.append((qi[row], vi[col], dist))
                size += len(row)
        if size > TILE_CELLS // 4:
            kept, size = _cut(*(np.concatenate(x) for x in zip(*held)), id_rank, q_ks), 0
            held = [kept]
    row, col, dist = _cut(*(np.concatenate(x) for x in zip(*held)), id_rank, q_ks)
    return _hit_frame(q_ids[row], ids[col], dist, q_ks[row])


def _block_rows(dim: int, k: int) -> int:
    """Rows of one side of a block: at most BLOCK_BYTES of doubles and about a million hits."""
    return max(1024, min(BLOCK_BYTES // (8 * max(dim, 1)), (1 << 20) // max(k, 1)))


def _hit_frame(query_ids, vector_ids, distances, ks):
    """Candidates as a frame of fixed types, also when there are none (NaN is written as NULL)."""
    import numpy as np
    import pandas as pd

    return pd.DataFrame({"query_id": np.asarray(query_ids, dtype=np.int64),
                         "vector_id": pd.Series(vector_ids, dtype=object),
                         "distance": np.asarray(distances, dtype=np.float64),
                         "k": np.asarray(ks, dtype=np.int32)})


def _final_topk(cands: DataFrame, largest_k: int) -> DataFrame:
    """Global top-k: the literal bound (the largest k asked for) lets Spark plan
    a WindowGroupLimit, so only that many rows per query and task reach the
    final sort."""
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "vector_id")
    return (cands.withColumn("rank", F.row_number().over(w))
            .filter((F.col("rank") <= F.lit(largest_k)) & (F.col("rank") <= F.col("k"))))


def search_topk(queries: DataFrame, vectors: DataFrame, k: int = P.DEFAULT_TOP_K,
                k_col: str | None = None, filter_col: str | None = None,
                query_vec: str = "embedding", vector_vec: str = "embedding",
                max_broadcast_bytes: int = 64 << 20, block_rows: int | None = None) -> DataFrame:
    """K2: per query, the ``top_k`` nearest vectors by cosine distance.

    ``queries``: ``query_id`` (long), ``query_vec``, optional ``k_col`` (per
    request k of any size, NULL -> ``k``) and ``filter_col`` (exact
    ``file_path`` or NULL).  ``vectors``: ``vector_id``, ``file_path``,
    ``vector_vec``.  A NULL vector on either side has NULL distances.  When
    every request names a file, only those files' vectors reach the kernel.
    Returns ``query_id, rank, vector_id, distance``.
    """
    kexpr = F.coalesce(F.col(k_col).cast("int"), F.lit(k)) if k_col else F.lit(k)
    qsel = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col(query_vec).alias("qv"),
        (F.col(filter_col) if filter_col else F.lit(None).cast("string")).alias("qf"),
        kexpr.alias("qk"))
    vsel = vectors.select("vector_id", "file_path", F.col(vector_vec).alias("vv"))

    # the request side is read three times (size check, broadcast, k); it is
    # materialised once in the shared checkpoint folder instead of recomputed
    qsel = materialize(qsel, "requests")
    stats = qsel.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qv")).alias("d"),
                     F.max("qk").alias("k"), F.count("qf").alias("scoped")).first()
    n_q, dim, largest_k = int(stats["n"]), max(int(stats["d"] or 0), 0), int(stats["k"] or 0)
    if n_q and stats["scoped"] == n_q:
        scopes = qsel.select(F.col("qf").alias("_scope")).distinct()
        vsel = vsel.join(scopes, F.col("file_path") == F.col("_scope"), "left_semi")
    if n_q and not dim:              # only NULL requests: the stored vectors name the dimension
        dim = max(int(vsel.agg(F.max(F.size("vv"))).first()[0] or 0), 0)
    if n_q * max(dim, 1) * 8 <= max_broadcast_bytes:
        cands = _broadcast_candidates(qsel, vsel, n_q, dim)
    else:
        cands = _blocked_candidates(qsel, vsel, n_q, block_rows or _block_rows(dim, largest_k), dim)
    hits = _final_topk(cands, largest_k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vector_id", "distance")


def _matrix(col, dim):
    """Stack a column of arrays into float64 rows (NULL -> zero vector)."""
    import numpy as np

    vals = [np.zeros(dim) if v is None else np.asarray(v, dtype=np.float64) for v in col]
    return np.stack(vals) if vals else np.zeros((0, dim))


def _broadcast_candidates(qsel: DataFrame, vsel: DataFrame, n_q: int, dim: int) -> DataFrame:
    # a small table may lie in one split, which many queries keep busy for long
    if n_q > TILE_ROWS:
        tasks = math.ceil(vsel.count() / max(TILE_ROWS, SCAN_CELLS // n_q))
        vsel = vsel.repartition(tasks) if tasks > 1 else vsel
    rows = qsel.toArrow()          # bounded: checked against max_broadcast_bytes
    q_mat = _matrix(rows["qv"].to_pandas(), dim)
    sc = vsel.sparkSession.sparkContext
    bq = sc.broadcast((rows["query_id"].to_pylist(), q_mat, rows["qf"].to_pylist(), rows["qk"].to_pylist()))

    def run(batches):
        ids, mat, filt, ks = bq.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            v_mat = _matrix(pdf["vv"], mat.shape[1])
            yield from _local_topk(ids, mat, filt, ks, pdf["vector_id"].tolist(), pdf["file_path"].tolist(), v_mat)

    return vsel.mapInPandas(run, HIT_SCHEMA)


def _blocked_candidates(qsel: DataFrame, vsel: DataFrame, n_q: int, block_rows: int, dim: int) -> DataFrame:
    n_v = vsel.count()
    qb = max(1, math.ceil(n_q / block_rows))
    vb = max(1, math.ceil(n_v / block_rows))
    vrep = vsel.withColumn("vb", F.pmod(F.xxhash64("vector_id"), F.lit(vb))) \
               .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    qrep = qsel.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb))) \
               .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))

    def run(key, vpdf, qpdf):
        import pandas as pd

        if len(vpdf) == 0 or len(qpdf) == 0:
            return _hit_frame([], [], [], [])
        qf = [None if (f is None or (isinstance(f, float) and math.isnan(f))) else f for f in qpdf["qf"]]
        found = list(_local_topk(qpdf["query_id"], _matrix(qpdf["qv"], dim), qf, qpdf["qk"], vpdf["vector_id"],
                                 vpdf["file_path"].tolist(), _matrix(vpdf["vv"], dim)))
        return pd.concat(found) if found else _hit_frame([], [], [], [])

    return (vrep.groupBy("vb", "qb").cogroup(qrep.groupBy("vb", "qb"))
            .applyInPandas(run, HIT_SCHEMA))


def attach_payload(hits: DataFrame, vectors: DataFrame, cols=("document", "metadata")) -> DataFrame:
    """Join the winning vectors' payload onto the hits (only ``k`` per query)."""
    return vectors.select("vector_id", *cols).join(hits, "vector_id")


def _list_order(q_mat, centers):
    """Per query, the lists by falling cosine of their centroid."""
    import numpy as np

    cn = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    qn = q_mat / np.maximum(np.linalg.norm(q_mat, axis=1, keepdims=True), 1e-300)
    return np.argsort(-(qn @ cn.T), axis=1, kind="stable")


def _probe_for_recall(queries: DataFrame, assigned: DataFrame, centers, k: int, recall: float,
                      sample: int = RECALL_SAMPLE) -> int:
    """The fewest lists that hold ``recall`` of K2's hits for a sample of the queries.

    The sample is taken by hash of the id; of a part of the queries, the mean
    recall has to exceed ``recall`` by two standard errors.  Hits at distance 0
    (the query's own row, copies) lie in its nearest list nearly always and
    NULL distances nowhere in particular, so neither counts.  All lists, if no
    smaller number is enough.
    """
    import numpy as np

    taken = queries.select("query_id", "qv").orderBy(F.xxhash64("query_id"), "query_id").limit(sample + 1)
    rows = taken.collect()                       # at most ``sample`` + 1 queries
    whole, rows = len(rows) <= sample, rows[:sample]
    some = queries.sparkSession.createDataFrame([(r.query_id, r.qv) for r in rows],
                                                "query_id long, embedding array<double>")
    hits = search_topk(some, assigned, k=k, vector_vec="vv").filter("distance > 1e-9")
    found = F.broadcast(hits.select("query_id", "vector_id")).join(assigned.select("vector_id", "list_id"), "vector_id")
    order = _list_order(_matrix([r.qv for r in rows], centers.shape[1]), centers) if rows else np.zeros((0, 1), int)
    place = {r.query_id: np.argsort(o) for r, o in zip(rows, order)}
    reached: dict[int, list[int]] = {}           # query -> places of its hits' lists
    for h in found.collect():                    # at most ``sample`` x k hits
        reached.setdefault(h.query_id, []).append(int(place[h.query_id][h.list_id]))
    for probe in range(1, len(centers)):
        share = np.array([np.mean(np.asarray(p) < probe) for p in reached.values()])
        error = 0.0 if whole or len(share) < 2 else 2 * share.std(ddof=1) / math.sqrt(len(share))
        if len(share) and share.mean() - error >= recall:
            return probe
    return len(centers)


def search_topk_approx(queries: DataFrame, vectors: DataFrame, k: int = P.DEFAULT_TOP_K,
                       n_lists: int | None = None, n_probe: int | None = None, recall: float = 0.9,
                       block_rows: int | None = None,
                       max_iter: int = 8, seed: int = 7, max_center_bytes: int = 64 << 20,
                       max_broadcast_bytes: int = 64 << 20,
                       query_vec: str = "embedding", vector_vec: str = "embedding") -> DataFrame:
    """K3: approximate top-k with an inverted-file layout, exactly re-ranked.

    MLlib ``KMeans`` (on unit vectors, so Euclidean ~ cosine) splits the
    vectors into ``n_lists`` lists; each query probes its ``n_probe`` nearest
    centroids.  A list is cut into blocks of about ``block_rows`` vectors, so
    a hot list never lands in one task.  The queries are broadcast up to
    ``max_broadcast_bytes``; above, they are cut into blocks by hash of their
    id, and ``cogroup`` on (list, block, query block) brings both together.
    Either way the probing queries are scored against the block, ``k`` per
    query are kept, and the global cut is K2's.  Recall grows with
    ``n_probe``; ``n_probe = n_lists`` is exact.  Without ``n_probe`` it is the
    fewest lists that give ``recall`` against K2 on a sample of the queries
    (``_probe_for_recall``).  A query whose probed lists
    hold fewer than ``k`` vectors goes on to further lists until they hold
    ``k``.  A centroid matrix above ``max_center_bytes`` is an error: choose
    fewer lists or a higher limit.  No vectors give no hits.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def unit(c):
        n = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return F.transform(c, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))

    vv = materialize(vectors.select("vector_id", "file_path", F.col(vector_vec).alias("vv"),
                                    array_to_vector(unit(F.col(vector_vec))).alias("features")), "ivf-input")
    n_v = vv.count()
    if not n_v:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vector_id string, distance double")
    dim = int(vv.select(F.max(F.size("vv"))).first()[0] or 1)
    # the centroids go to the driver and are broadcast: their size is checked
    block_rows = block_rows or _block_rows(dim, k)
    lists = n_lists or max(1, int(math.sqrt(n_v)))
    if lists * dim * 8 > max_center_bytes:
        raise ValueError(f"{lists} centroids of {dim} dimensions exceed max_center_bytes = {max_center_bytes}")
    model = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="list_id").fit(vv)
    centers = [c.tolist() for c in model.clusterCenters()]   # lists x dim, bounded by ``n_lists``
    assigned = materialize(model.transform(vv).select("vector_id", "file_path", "vv", "list_id"), "ivf-lists")
    # rows per list: at most ``lists`` of them; only lists above block_rows are cut
    counted = {r["list_id"]: r["count"] for r in assigned.groupBy("list_id").count().collect()}
    sizes = [counted.get(i, 0) for i in range(len(centers))]
    blocks = F.broadcast(vectors.sparkSession.createDataFrame(
        [(i, max(1, math.ceil(n / block_rows))) for i, n in enumerate(sizes)], "list_id int, blocks int"))
    vblk = assigned.join(blocks, "list_id") \
                   .withColumn("blk", F.pmod(F.xxhash64("vector_id"), F.col("blocks")).cast("int")).drop("blocks")
    qsel = queries.select(F.col("query_id").cast("long").alias("query_id"),
                          F.col(query_vec).cast("array<double>").alias("qv"))
    qsel = materialize(qsel, "ivf-queries")
    n_q = qsel.count()
    if n_probe is None:
        import numpy as np

        n_probe = _probe_for_recall(qsel, assigned, np.asarray(centers, dtype=np.float64), k, recall)

    probe = max(1, min(n_probe, len(centers)))

    def probed(q_mat):
        """(query, list) places: the nearest ``probe`` lists, and further ones until they hold ``k``."""
        import numpy as np

        held = np.asarray(sizes, dtype=np.float64)
        best = _list_order(q_mat, np.asarray(centers, dtype=np.float64))
        before = np.cumsum(held[best], axis=1) - held[best]       # vectors in the nearer lists
        row, place = np.nonzero((before < k) | (np.arange(len(held)) < probe))
        return row, best[row, place]

    if n_q * max(dim * 8, len(centers) // 8) <= max_broadcast_bytes:
        cands = _broadcast_probes(qsel, vblk, probed, dim, len(centers), k)
    else:
        cands = _blocked_probes(qsel, vblk, blocks, probed, dim, n_q, block_rows, k)
    hits = _final_topk(cands, k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vector_id", "distance")


def _frame_topk(q_ids, q_mat, vpdf, dim, k):
    """A frame of the best ``k`` hits of every query among one block of a list."""
    import pandas as pd

    found = list(_local_topk(q_ids, q_mat, [None] * len(q_ids), [k] * len(q_ids), vpdf["vector_id"],
                             vpdf["file_path"].tolist(), _matrix(vpdf["vv"], dim)))
    return pd.concat(found) if found else _hit_frame([], [], [], [])


def _broadcast_probes(qsel: DataFrame, vblk: DataFrame, probed, dim: int, n_lists: int, k: int) -> DataFrame:
    """Every block of a list against the broadcast queries that probe it (a bit per query and list)."""
    import numpy as np

    rows = qsel.toArrow()          # bounded: checked against max_broadcast_bytes
    q_ids, q_mat = np.asarray(rows["query_id"].to_pylist(), dtype=np.int64), _matrix(rows["qv"].to_pandas(), dim)
    bits = [np.zeros((n_lists, 0), np.uint8)]
    for at in range(0, len(q_mat), 4096):
        row, lists = probed(q_mat[at:at + 4096])
        on = np.zeros((n_lists, len(q_mat[at:at + 4096])), bool)
        on[lists, row] = True
        bits.append(np.packbits(on, axis=1))
    bq = vblk.sparkSession.sparkContext.broadcast((q_ids, q_mat, np.concatenate(bits, axis=1)))

    def run(key, vpdf):
        ids, mat, probes = bq.value
        mine = np.flatnonzero(np.unpackbits(probes[key[0]], count=len(ids)))
        return _frame_topk(ids[mine], mat[mine], vpdf, dim, k)

    return vblk.groupBy("list_id", "blk").applyInPandas(run, HIT_SCHEMA)


def _blocked_probes(qsel: DataFrame, vblk: DataFrame, blocks: DataFrame, probed, dim: int, n_q: int,
                    block_rows: int, k: int) -> DataFrame:
    """Blocks of lists and blocks of the queries that probe them meet in ``cogroup``."""
    # a list can be probed by any share of the queries: they are cut into blocks, too
    qblocks = max(1, math.ceil(n_q / block_rows))
    vrep = vblk.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))

    def nearest_lists(batches):
        import numpy as np

        for pdf in batches:
            if len(pdf) == 0:
                continue
            row, lists = probed(_matrix(pdf["qv"], dim))
            yield pdf.assign(lists=np.split(lists.astype(np.int32), np.searchsorted(row, np.arange(1, len(pdf)))))

    probes = qsel.mapInPandas(nearest_lists, "query_id long, qv array<double>, lists array<int>") \
                 .select("query_id", "qv", F.explode("lists").alias("list_id")).join(blocks, "list_id") \
                 .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qblocks)).cast("int")) \
                 .withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key, vpdf, qpdf):
        if len(vpdf) == 0 or len(qpdf) == 0:
            return _hit_frame([], [], [], [])
        return _frame_topk(qpdf["query_id"].to_numpy(), _matrix(qpdf["qv"], dim), vpdf, dim, k)

    return (vrep.groupBy("list_id", "blk", "qb").cogroup(probes.groupBy("list_id", "blk", "qb"))
            .applyInPandas(run, HIT_SCHEMA))
