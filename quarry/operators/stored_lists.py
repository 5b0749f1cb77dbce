"""K3 over a stored inverted file: trained once, added to without training, searched with
filters and a k per request.

Layout under one folder (any Hadoop-compatible shared path)::

    centers/   list_id, center          one row per list
    about/     one row: dimension, lists, folders, vectors trained on, shares of the vectors a search probes
    vectors/batch_id=N/part=P/   vector_id, file_path, ingest_seq, list_id, vv    (sorted by list;
               P = list_id modulo the folders; a batch is replaced as a whole, so adding it again changes nothing)
    counts/batch_id=N/   file_path, ingest_seq, list_id, n                       vectors of each file version in each list

* **Training** fits unit vectors on at most ``SAMPLE_PER_LIST`` rows a list
  (taken by hash; a bounded sample), every vector is then assigned.  There are
  sqrt(n) lists, or as many as ``max_center_bytes`` holds, so no size is an error.
* **Shares.**  The share of the matching vectors that a search looks at is measured
  once, when the lists are trained, without a filter and with one: the least that
  gives the asked recall against K2 on a sample of the stored vectors (each asks
  for its neighbours, in its own file where there is a filter), less two standard errors.
* **Adding** assigns to the trained centers.  ``needs_training`` says when the
  stored vectors have outgrown them (``GROWTH`` times as many).
* **Search.**  A query goes through the lists by falling cosine of their center
  until they hold that share of the vectors that *match its filter*, and at
  least its k; the matching vectors of each list come from ``counts``, lists
  without any are passed over.  Only folders of probed lists are read.  Each
  probed list is scored in place against the queries that probe it (no shuffle
  of vectors up to ``max_broadcast_bytes`` of queries; above, both sides meet in
  bounded blocks), and the final cut is K2's.

A NULL vector is kept in list 0 and has NULL distances; no vectors give no hits.
With ``live`` (file_path, ingest_seq) only vectors of those file versions count
and are found, so re-uploads and deletes need no rewriting of the lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.operators.search import HIT_SCHEMA, _block_rows, _final_topk, _hit_frame, _list_order, _listed_topk, _matrix, search_topk
from quarry.session import materialize

FOLDERS, LISTS_PER_FOLDER, SAMPLE_PER_LIST, GROWTH, ASKED = 64, 16, 64, 4, 256
_VECTORS = "vector_id string, file_path string, ingest_seq long, list_id int, vv array<float>"


def _unit(c):
    n = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


@dataclass
class StoredLists:
    """An open inverted file; ``centers`` is lists x dimension, within ``max_center_bytes``."""

    spark: SparkSession
    path: str
    centers: object
    trained_on: int
    share: float                # of the vectors, without a filter
    scoped_share: float         # of the vectors that match a filter
    sizes: dict | None = None   # vectors of each list, where known

    @property
    def folders(self) -> int:
        return min(FOLDERS, max(1, len(self.centers) // LISTS_PER_FOLDER))

    # ------------------------------------------------------------- building
    @classmethod
    def train(cls, vectors: DataFrame, path: str, n_lists: int | None = None, recall: float = 0.9, k: int = P.DEFAULT_TOP_K,
              share: float | None = None, max_iter: int = 8, seed: int = 7, max_center_bytes: int = 64 << 20) -> "StoredLists | None":
        """Train lists on ``vectors`` (vector_id, file_path, ingest_seq, embedding), write them with all
        vectors to ``path`` and open them; None without any vector.  ``share``: given instead of measured."""
        import numpy as np
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        rows = materialize(_plain(vectors), "lists-input")
        about = rows.agg(F.count("vv").alias("n"), F.max(F.size("vv")).alias("d")).first()
        if not about.n:
            return None
        lists = max(1, min(n_lists or int(math.sqrt(about.n)), max_center_bytes // (8 * about.d)))
        keep = min(1.0, SAMPLE_PER_LIST * lists / about.n)
        place = F.pmod(F.xxhash64("vector_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.filter(F.col("vv").isNotNull() & (place < keep)).select(array_to_vector(_unit(F.col("vv"))).alias("features"))
        model = KMeans(k=lists, seed=seed, maxIter=max_iter).fit(sample)
        centers = np.asarray(model.clusterCenters())
        opened = cls(spark, path.rstrip("/"), centers, int(about.n), 1.0, 1.0)
        opened._write(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list_id int, center array<double>"),
                      "centers", "overwrite")
        assigned = opened._append(rows, 0)
        if share is None:
            opened.share, opened.scoped_share = (opened._measured(assigned, k, recall, scoped) for scoped in (False, True))
        else:
            opened.share = opened.scoped_share = float(share)
        opened._write(spark.createDataFrame([(int(about.d), lists, opened.trained_on, opened.share, opened.scoped_share)],
                                            "dim int, lists int, trained_on long, share double, scoped_share double"),
                      "about", "overwrite")
        return opened

    def _measured(self, assigned: DataFrame, k: int, recall: float, scoped: bool) -> float:
        """The least share that holds ``recall`` of K2's hits for a sample of the stored vectors.

        Hits at distance 0 (a vector's own row, copies) lie in its nearest list nearly always and NULL
        distances nowhere in particular, so neither counts."""
        import numpy as np

        known = assigned.filter("vv is not null")
        rows = known.select("vector_id", "file_path", "vv").orderBy(F.xxhash64("vector_id"), "vector_id").limit(ASKED).collect()
        asked = self.spark.createDataFrame([(i, r.vv, r.file_path if scoped else None) for i, r in enumerate(rows)],
                                           "query_id long, embedding array<float>, qf string")
        hits = search_topk(asked, known, k=k, filter_col="qf", vector_vec="vv").filter("distance > 1e-9")
        hits = F.broadcast(hits.select("query_id", "vector_id")).join(known.select("vector_id", "list_id"), "vector_id").collect()
        wanted = self.spark.createDataFrame([(p,) for p in {r.file_path for r in rows}], "of string")
        here = self._counts().join(F.broadcast(wanted), F.col("of").eqNullSafe(F.col("file_path")), "left_semi") if scoped else self._counts()
        n: dict = {}
        for r in here.groupBy(*(["file_path"] if scoped else []), "list_id").agg(F.sum("n").alias("n")).collect():
            n.setdefault(r.file_path if scoped else None, np.zeros(len(self.centers)))[r.list_id] = r.n
        order = _list_order(_matrix([r.vv for r in rows], self.centers.shape[1]), self.centers)
        needs: dict[int, list[float]] = {}              # query -> share before each of its hits' lists
        for h in hits:                                  # at most ASKED x k
            of = n[rows[h.query_id].file_path if scoped else None][order[h.query_id]]
            before = (np.cumsum(of) - of)[int(np.flatnonzero(order[h.query_id] == h.list_id)[0])]
            needs.setdefault(h.query_id, []).append(before / of.sum())
        for share in np.arange(0.01, 1.0, 0.01):
            found = np.array([np.mean(np.asarray(x) < share) for x in needs.values()])
            error = 2 * found.std(ddof=1) / math.sqrt(len(found)) if len(found) > 1 else 0.0
            if len(found) and found.mean() - error >= recall:
                return float(share)
        return 1.0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "StoredLists":
        """The lists written under ``path``; nothing is trained."""
        import numpy as np

        path = path.rstrip("/")
        about = spark.read.parquet(f"{path}/about").first()
        rows = spark.read.parquet(f"{path}/centers").orderBy("list_id").collect()      # within max_center_bytes
        return cls(spark, path, np.asarray([r.center for r in rows]), about.trained_on, about.share, about.scoped_share)

    def add(self, vectors: DataFrame, batch_id: int) -> None:
        """Assign further vectors to the trained lists, as batch ``batch_id`` (0 holds those trained on)."""
        self._append(_plain(vectors), batch_id)

    def needs_training(self) -> bool:
        """Whether the stored vectors have outgrown the lists."""
        return self._counts().agg(F.sum("n")).first()[0] > GROWTH * self.trained_on

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        df.write.mode(mode).parquet(f"{self.path}/{table}")

    def _append(self, rows: DataFrame, batch_id: int) -> DataFrame:
        centers = self.spark.sparkContext.broadcast(self.centers)

        def nearest(frames):
            for pdf in frames:
                order = _list_order(_matrix(pdf["vv"], centers.value.shape[1]), centers.value)[:, 0] if len(pdf) else []
                yield pdf.assign(list_id=order)

        assigned = materialize(rows.mapInPandas(nearest, _VECTORS), "lists-assigned")
        ordered = assigned.withColumn("part", F.pmod("list_id", F.lit(self.folders))) \
            .repartitionByRange("part", "list_id", "vector_id").sortWithinPartitions("part", "list_id")
        ordered.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/vectors/batch_id={int(batch_id)}")
        self.sizes = None
        self._write(assigned.groupBy("file_path", "ingest_seq", "list_id").agg(F.count(F.lit(1)).alias("n")),
                    f"counts/batch_id={int(batch_id)}", "overwrite")
        return assigned

    # ------------------------------------------------------------ searching
    def _counts(self) -> DataFrame:
        return self.spark.read.schema("file_path string, ingest_seq long, list_id int, n long, batch_id long").parquet(f"{self.path}/counts")

    def _live(self, df: DataFrame, live: DataFrame | None) -> DataFrame:
        return df if live is None else df.join(live.select("file_path", "ingest_seq"), ["file_path", "ingest_seq"], "left_semi")

    def search(self, queries: DataFrame, k: int = P.DEFAULT_TOP_K, k_col: str | None = None, filter_col: str | None = None,
               query_vec: str = "embedding", live: DataFrame | None = None, share: float | None = None,
               max_broadcast_bytes: int = 64 << 20, block_rows: int | None = None) -> DataFrame:
        """K3: ``query_id, rank, vector_id, distance`` of about the nearest; arguments as K2's.  A ``share`` of 1 is exact."""
        kexpr = F.coalesce(F.col(k_col).cast("int"), F.lit(k)) if k_col else F.lit(k)
        asked = queries.select(
            F.col("query_id").cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("qv"),
            (F.col(filter_col) if filter_col else F.lit(None).cast("string")).alias("qf"), kexpr.cast("int").alias("qk"))
        counts = self._live(self._counts(), live)
        held = self.sizes if live is None else None
        if held is None:
            held = {r.list_id: r.n for r in counts.groupBy("list_id").agg(F.sum("n").alias("n")).collect()}      # one row a list
            self.sizes = held if live is None else None
        probes = materialize(self._probes(asked, counts, held, share, filter_col is not None), "lists-probes")
        about = probes.agg(F.count(F.lit(1)).alias("n"), F.max("qk").alias("k")).first()
        if not about.n or not held:
            return self.spark.createDataFrame([], "query_id long, rank int, vector_id string, distance double")
        if about.n * (8 * self.centers.shape[1] + len(self.centers) // 8 + 64) <= max_broadcast_bytes:
            found = self._in_place(probes, live)
        else:
            lists = [r.list_id for r in probes.select(F.explode("lists").alias("list_id")).distinct().collect()]  # one a list at most
            found = self._in_blocks(probes, self._live(self._rows(lists), live), about.n, held,
                                    block_rows or _block_rows(self.centers.shape[1], int(about.k or 0)))
        hits = _final_topk(found, max(int(about.k or 0), 0))
        return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vector_id", "distance")

    def _probes(self, asked: DataFrame, counts: DataFrame, held: dict, share: float | None, filtered: bool) -> DataFrame:
        """query_id, qv, qf, qk, lists: the lists each query probes."""
        import numpy as np

        everywhere = np.zeros(len(self.centers))
        for i, n in held.items():
            everywhere[i] = n
        centers = self.spark.sparkContext.broadcast((self.centers, everywhere))
        shares = (share or self.share, share or self.scoped_share)
        if filtered:                 # the vectors of a file by list: at most one entry a list
            of_file = counts.groupBy("file_path", "list_id").agg(F.sum("n").alias("n")).groupBy("file_path").agg(
                F.collect_list(F.struct("list_id", "n")).alias("here"))
            of_file = of_file.select("file_path", F.col("here.list_id").alias("here"), F.col("here.n").alias("n_here"))
            asked = asked.join(of_file, F.col("qf") == F.col("file_path"), "left").drop("file_path")
        else:
            asked = asked.withColumn("here", F.lit(None).cast("array<int>")).withColumn("n_here", F.lit(None).cast("array<long>"))

        def choose(frames):
            mat, all_held = centers.value
            for pdf in frames:
                chosen = []
                order = _list_order(_matrix(pdf["qv"], mat.shape[1]), mat) if len(pdf) else []
                for best, qf, qk, here, n_here in zip(order, pdf["qf"], pdf["qk"], pdf["here"], pdf["n_here"]):
                    n = all_held
                    if qf is not None:
                        n = np.zeros(len(mat))
                        if here is not None:
                            n[here] = n_here
                    best = best[n[best] > 0]
                    before = np.cumsum(n[best]) - n[best]
                    enough = max(int(qk), math.ceil(shares[qf is not None] * n.sum()))
                    chosen.append(best[before < enough].astype(np.int32))
                yield pdf.assign(lists=chosen)[["query_id", "qv", "qf", "qk", "lists"]]

        return asked.mapInPandas(choose, "query_id long, qv array<double>, qf string, qk int, lists array<int>")

    def _rows(self, lists: list) -> DataFrame:
        """Stored vectors of these lists: other folders are not read."""
        rows = self.spark.read.schema(_VECTORS + ", batch_id long, part int").parquet(f"{self.path}/vectors")
        if len(lists) < len(self.centers):
            rows = rows.filter(F.col("part").isin(sorted({i % self.folders for i in lists})) & F.col("list_id").isin(sorted(lists)))
        return rows.drop("batch_id", "part")

    def _in_place(self, probes: DataFrame, live: DataFrame | None) -> DataFrame:
        """Every stored run of a list against the broadcast queries that probe it."""
        import numpy as np

        asked = probes.toArrow()                         # bounded: checked against max_broadcast_bytes
        dim = self.centers.shape[1]
        on = np.zeros((len(self.centers), len(asked)), bool)
        for i, lists in enumerate(asked["lists"].to_pylist()):
            on[lists, i] = True
        rows = self._live(self._rows(np.flatnonzero(on.any(axis=1)).tolist()), live)
        asked = self.spark.sparkContext.broadcast((
            np.asarray(asked["query_id"].to_pylist(), np.int64), _matrix(asked["qv"].to_pandas(), dim),
            np.asarray(asked["qf"].to_pylist(), object), np.asarray(asked["qk"].to_pylist(), np.int32),
            np.packbits(on, axis=1)))

        def run(frames):
            ids, mat, filters, ks, probing = asked.value
            for pdf in frames:
                if len(pdf):
                    yield _listed_topk(ids, mat, filters, ks, lambda i: np.flatnonzero(np.unpackbits(probing[i], count=len(ids))),
                                       pdf["vector_id"], pdf["file_path"], pdf["list_id"].to_numpy(), _matrix(pdf["vv"], dim))

        return rows.select("list_id", "file_path", "vector_id", "vv").mapInPandas(run, HIT_SCHEMA)

    def _in_blocks(self, probes: DataFrame, rows: DataFrame, n_q: int, held: dict, block_rows: int) -> DataFrame:
        """Blocks of neighbouring lists (of part of one, where it is larger) and blocks of the queries that
        probe any of them meet in tasks, so a query travels once a block and not once a list."""
        import numpy as np

        dim, q_blocks = self.centers.shape[1], max(1, math.ceil(n_q / block_rows))
        first, parts = np.zeros(len(self.centers), np.int64), np.zeros(len(self.centers), np.int64)
        n_blocks, room = 0, 0
        for i, n in sorted(held.items()):
            parts[i] = max(1, math.ceil(n / block_rows))
            if parts[i] > 1 or n > room:
                n_blocks, room = n_blocks + int(parts[i]), block_rows if parts[i] == 1 else 0
            first[i], room = n_blocks - parts[i], room - n
        blocks = F.broadcast(self.spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in held],
                                                        "list_id int, first int, parts int"))          # one row a list
        stored = rows.join(blocks, "list_id").withColumn("blk", F.col("first") + F.pmod(F.xxhash64("vector_id"), F.col("parts")).cast("int")) \
            .select("blk", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), "list_id", "file_path", "vector_id", "vv")

        def deal(frames):
            for pdf in frames:
                for at in range(0, len(pdf), 1024):
                    some = pdf.iloc[at:at + 1024]
                    row = np.repeat(np.arange(len(some)), [len(x) for x in some["lists"]])
                    if not len(row):
                        continue
                    lists = np.concatenate(some["lists"].tolist())
                    again = np.repeat(np.arange(len(row)), parts[lists])
                    blk = first[lists][again] + np.arange(len(again)) - np.searchsorted(again, again)
                    row, lists = row[again], lists[again]
                    by = np.lexsort((lists, blk, row))
                    row, lists, blk = row[by], lists[by], blk[by]
                    cut = np.flatnonzero(np.diff(row) | np.diff(blk)) + 1
                    start = np.concatenate([[0], cut])
                    out = some.iloc[row[start]].assign(ab=blk[start], lists=np.split(lists.astype(np.int32), cut))
                    yield out[["ab", "query_id", "qv", "qf", "qk", "lists"]]

        asked = probes.mapInPandas(deal, "ab int, query_id long, qv array<double>, qf string, qk int, lists array<int>") \
            .withColumn("aq", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))

        def run(key, vpdf, qpdf):
            if not len(vpdf) or not len(qpdf):
                return _hit_frame([], [], [], [])
            filters = np.array([None if x is None or x != x else x for x in qpdf["qf"]], object)
            row = np.repeat(np.arange(len(qpdf)), [len(x) for x in qpdf["lists"]])
            lists = np.concatenate(qpdf["lists"].tolist())
            by = np.argsort(lists, kind="stable")
            row, lists = row[by], lists[by]
            return _listed_topk(qpdf["query_id"], _matrix(qpdf["qv"], dim), filters, qpdf["qk"],
                                lambda i: row[np.searchsorted(lists, i):np.searchsorted(lists, i, "right")],
                                vpdf["vector_id"], vpdf["file_path"], vpdf["list_id"].to_numpy(), _matrix(vpdf["vv"], dim))

        return stored.groupBy("blk", "qb").cogroup(asked.groupBy("ab", "aq")).applyInPandas(run, HIT_SCHEMA)


def nearest(queries: DataFrame, vectors: DataFrame, lists: "StoredLists | None" = None, live: DataFrame | None = None,
            **asked) -> DataFrame:
    """K2 over ``vectors``, or K3 over stored lists (of which only ``live`` file versions are found); ``asked`` as K2's."""
    return search_topk(queries, vectors, **asked) if lists is None else lists.search(queries, live=live, **asked)


def _plain(vectors: DataFrame) -> DataFrame:
    seq = F.col("ingest_seq") if "ingest_seq" in vectors.columns else F.lit(0)
    return vectors.select("vector_id", "file_path", seq.cast("long").alias("ingest_seq"), F.col("embedding").cast("array<float>").alias("vv"))
