"""Persisted index (S4 write_index, S5 read_index) and code-file sources.

Layout under one store folder (any Hadoop-compatible shared path)::

    files/batch_id=N/attempt=A/       files log (upserts, tombstones, clears)
    functions/batch_id=N/attempt=A/   functions log
    call_edges/batch_id=N/attempt=A/  call-edge log
    vectors/batch_id=N/attempt=A/     vector log
    commits/batch_id=N/attempt=A/     one row, written last: this attempt is batch N
    claims/<sequence>                 which stream's micro-batch owns a sequence (S3)
    lists/gen=G/                      the stored inverted file over the vectors, if asked for (K3)
    base/                             rows of settled batches, in buckets (``sources/base.py``)

Every attempt at a batch writes folders of its own and becomes visible by its
one commit row.  A reader takes the newest committed attempt of each batch
and prunes all other folders by partition, so during a re-run it sees the old
attempt or the new one, never rows of both, and a failed attempt leaves nothing
that is read.  The functions of a batch are written first and read back: edges,
vectors and file rows derive from the written table, which cuts the lineage (a
lost executor recomputes from that table, not from the raw corpus).

A path that a batch holds several times counts once: its last row by
``source_code`` order is taken, whatever the order of arrival.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators.inference import DEFAULT_DIM, EmbedFn, embed
from quarry.operators.languages import split_empty, split_supported
from quarry.operators.extract import extract_functions
from quarry.operators.stored_lists import StoredLists
from quarry.session import materialize
from quarry.sources import base as bs

TABLES = ("files", "functions", "call_edges", "vectors")

# Declared schemas (a table can have no files yet, e.g. a batch without calls)
SCHEMAS = {
    "files": "file_path string, file_name string, function_count int, upload_time timestamp, "
             "ingest_seq long, op string",
    "functions": "file_path string, ingest_seq long, function_name string, return_type string, "
                 "parameters string, line_start int, line_end int, complexity int, tags array<string>, "
                 "tags_str string, calls array<string>, language string, open_off long, vector_id string, "
                 "body string, body_preview string",
    "call_edges": "file_path string, caller string, caller_line int, callee_name string, ingest_seq long",
    "vectors": "vector_id string, file_path string, ingest_seq long, document string, "
               "metadata struct<function_name:string,file_path:string,complexity:int,tags:string,"
               "line_start:int,line_end:int>, embedding array<float>",
}


# ------------------------------------------------------------------ sources
def read_code_files(spark: SparkSession, path: str, glob: str | None = None,
                    recursive: bool = True) -> DataFrame:
    """Whole files from a folder as ``(file_path, file_name, source_code)``.

    Bytes are decoded as UTF-8 with replacement characters (invalid sequences
    become U+FFFD, as Python's ``errors="replace"``).  ``file_path`` is
    ``/uploads/`` plus the path relative to ``path``, so equal base names in
    different sub-folders stay distinct.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    raw = reader.load(path).select("path", "content")
    return _decode(raw, path)


def _decode(raw: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^(file:)?/*", "/")
    root_norm = "/" + base.lstrip("/").removeprefix("file:").lstrip("/")
    rel = F.when(rel.startswith(root_norm + "/"), F.substr(rel, F.lit(len(root_norm) + 2))) \
           .otherwise(F.substring_index(rel, "/", -1))
    return raw.select(
        F.concat(F.lit("/uploads/"), rel).alias("file_path"),
        F.substring_index(F.col("path"), "/", -1).alias("file_name"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("source_code"),
    )


def read_code_table(df: DataFrame, path_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """The same corpus shape from any table (parquet, JDBC, …)."""
    name = F.col(name_col) if name_col else F.substring_index(F.col(path_col), "/", -1)
    return df.select(F.col(path_col).alias("file_path"), name.alias("file_name"),
                     F.col(text_col).cast("string").alias("source_code"))


# ------------------------------------------------------------------- writing
def _attempt() -> str:
    """Names sort by time; the random part keeps two writers apart."""
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f") + "-" + uuid.uuid4().hex[:12]


def _folder(store: str, table: str, batch_id: int, attempt: str) -> str:
    return f"{store.rstrip('/')}/{table}/batch_id={int(batch_id)}/attempt={attempt}"


def _write(df: DataFrame, store: str, table: str, batch_id: int, attempt: str) -> None:
    df.write.mode("overwrite").parquet(_folder(store, table, batch_id, attempt))


def _commit(spark: SparkSession, store: str, batch_id: int, attempt: str) -> None:
    row = spark.createDataFrame([(attempt,)], "committed string").coalesce(1)
    _write(row, store, "commits", batch_id, attempt)


@dataclass
class WriteResult:
    unsupported: DataFrame
    empty: DataFrame


def one_row_per_path(files: DataFrame) -> DataFrame:
    """Files with each path once (the largest text of a repeated path)."""
    others = [c for c in files.columns if c not in ("file_path", "source_code")]
    return files.groupBy("file_path").agg(F.max(F.struct("source_code", *others)).alias("_row")).select("file_path", "_row.*") \
        .select(*files.columns)


def write_index(spark: SparkSession, files: DataFrame, store: str, batch_id: int,
                upload_time: str, embed_fn: EmbedFn | None = None,
                dim: int = DEFAULT_DIM, unique_paths: bool = False, lists: bool = False) -> WriteResult:
    """S4 + E1: index ``files`` as batch ``batch_id`` (= ``ingest_seq``).

    ``unique_paths``: the caller knows that no path is repeated, so the texts
    need no shuffle to find out.  ``lists``: keep the stored inverted file (K3) up to date.
    """
    _refuse_settled(spark, store, batch_id)
    attempt = _attempt()
    if not unique_paths and _repeated(files):
        files = one_row_per_path(files)
    accepted, unsupported = split_supported(files)
    _write(ix.function_rows(extract_functions(accepted), batch_id), store, "functions", batch_id, attempt)
    # everything below reads the written attempt back (lineage cut)
    ext = spark.read.parquet(_folder(store, "functions", batch_id, attempt))
    _write(ix.edge_rows(ext, batch_id), store, "call_edges", batch_id, attempt)
    _write(embed(ix.vector_rows(ext, batch_id), "document", embed_fn, dim), store, "vectors", batch_id, attempt)
    kept, empty = split_empty(accepted, ext)
    rows = ix.file_rows(kept, ext, batch_id, upload_time).unionByName(ix.rejected_rows(empty, batch_id, upload_time))
    _write(rows, store, "files", batch_id, attempt)
    _commit(spark, store, batch_id, attempt)
    if lists:
        update_lists(spark, store, batch_id)
    return WriteResult(unsupported=unsupported, empty=empty)


def is_settled(spark: SparkSession, store: str, batch_id: int) -> bool:
    """Whether ``compact_touched`` has taken this batch into the base: what it replaced is gone, so it can't be run again."""
    return int(batch_id) in bs.open_base(spark, store).settled


def _refuse_settled(spark: SparkSession, store: str, batch_id: int) -> None:
    if is_settled(spark, store, batch_id):
        raise ValueError(f"batch {batch_id} is part of the compacted base; write its files as a new batch")


def _repeated(files: DataFrame) -> bool:
    """Whether any path stands twice (paths only are shuffled)."""
    return bool(files.groupBy("file_path").count().filter("count > 1").take(1))


def delete_files(spark: SparkSession, paths: DataFrame, store: str, batch_id: int,
                 upload_time: str) -> None:
    """D4 persisted: a tombstone batch; children disappear from every view."""
    _refuse_settled(spark, store, batch_id)
    attempt = _attempt()
    _write(ix.tombstones(paths, batch_id, upload_time), store, "files", batch_id, attempt)
    _commit(spark, store, batch_id, attempt)


def delete_functions(spark: SparkSession, paths: DataFrame, store: str, batch_id: int, upload_time: str) -> None:
    """D4, second half, persisted: functions and edges of ``paths`` go, their files rows and vectors stay."""
    _refuse_settled(spark, store, batch_id)
    attempt = _attempt()
    _write(ix.clears(paths, batch_id, upload_time), store, "files", batch_id, attempt)
    _commit(spark, store, batch_id, attempt)


def update_lists(spark: SparkSession, store: str, batch_id: int, recall: float = 0.9) -> StoredLists | None:
    """K3: assign the vectors of batch ``batch_id`` to the trained lists, or train a new generation of lists
    over the current vectors if there is none or they have outgrown it."""
    current = open_lists(spark, store)
    if current is not None and not current.needs_training():
        current.add(_log(spark, store, "vectors", _committed(spark, store)).filter(F.col("ingest_seq") == int(batch_id)), batch_id)
        return current
    return StoredLists.train(read_index(spark, store, lists=False).vectors, f"{store.rstrip('/')}/lists/gen={_attempt()}", recall=recall)


def open_lists(spark: SparkSession, store: str) -> StoredLists | None:
    """The newest generation of lists whose training is complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/lists")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().toString() for f in fs.listStatus(root)), reverse=True) if fs.exists(root) else []
    for path in found:                                   # one folder for each training
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")):
            return StoredLists.open(spark, path)
    return None


# ------------------------------------------------------------------- reading
@dataclass
class Index:
    files_log: DataFrame
    files: DataFrame
    functions: DataFrame
    edges: DataFrame
    vectors: DataFrame
    uploads: DataFrame
    lists: StoredLists | None = None


def _attempts(spark: SparkSession, store: str, base: bs.Base) -> dict[int, str]:
    """The newest committed attempt of each batch that is not in the base (one name a batch, as many as the store has folders anyway)."""
    rows = spark.read.schema("committed string, batch_id long, attempt string").parquet(f"{store.rstrip('/')}/commits")
    found = {r.batch_id: r.attempt for r in rows.groupBy("batch_id").agg(F.max("attempt").alias("attempt")).collect()}
    return {b: a for b, a in found.items() if b not in base.settled}


def _committed(spark: SparkSession, store: str) -> list[str]:
    return list(_attempts(spark, store, bs.open_base(spark, store)).values())


def _log(spark: SparkSession, store: str, table: str, attempts: list[str]) -> DataFrame:
    """A table's log: rows of these attempts.  The filter is on the partition column, so other folders are not read."""
    schema = f"{SCHEMAS[table]}, batch_id long, attempt string"
    try:
        rows = spark.read.schema(schema).parquet(f"{store.rstrip('/')}/{table}")
    except AnalysisException:                            # no batch has written this table (a store of deletes only)
        rows = spark.createDataFrame([], schema)
    return rows.filter(F.col("attempt").isin(attempts)).drop("batch_id", "attempt")


def _base_and_log(spark: SparkSession, store: str, table: str, attempts: list[str], base: bs.Base,
                  only: list[int] | None = None) -> DataFrame:
    """All rows of a table: the base's (of the buckets ``only``) and those of later batches."""
    log = _log(spark, store, table, attempts)
    return bs.base_rows(spark, store, table, SCHEMAS[table], base, only).unionByName(log) if base.held else log


def _live_rows(child_log: DataFrame, files_log: DataFrame, live: DataFrame, dead_bytes: int) -> DataFrame:
    """Children of live versions.  A committed batch has a files row for each child, so what is not dead is live;
    versions die by re-uploads and deletes since the last compaction, mostly few, and while they fit in ``dead_bytes``
    they travel to the children, whose bodies and vectors are not shuffled.  Beyond, the children meet the live versions."""
    dead = materialize(ix.dead_versions(files_log, live), "dead-versions")
    size = dead.agg(F.sum(F.octet_length("file_path") + 24)).first()[0] or 0
    keys = ["file_path", "ingest_seq"]
    if size <= dead_bytes:
        return child_log.join(F.broadcast(dead), keys, "left_anti")
    return child_log.join(live, keys, "left_semi")


def read_index(spark: SparkSession, store: str, lists: bool = True, dead_bytes: int = 64 << 20) -> Index:
    """The four tables as current views over their logs, the uploads, and the stored lists, if there are any."""
    base = bs.open_base(spark, store)
    idx = _views(spark, store, list(_attempts(spark, store, base).values()), base, dead_bytes)
    idx.lists = open_lists(spark, store) if lists else None
    return idx


def _views(spark: SparkSession, store: str, attempts: list[str], base: bs.Base, dead_bytes: int = 64 << 20,
           only: list[int] | None = None) -> Index:
    def log(table):
        return _base_and_log(spark, store, table, attempts, base, only)

    files_log = log("files")
    with_functions, live = ix.live_function_versions(files_log), ix.live_versions(files_log)
    return Index(
        files_log=files_log,
        files=ix.current_files(files_log),
        functions=_live_rows(log("functions"), files_log, with_functions, dead_bytes),
        edges=_live_rows(log("call_edges"), files_log, with_functions, dead_bytes),
        vectors=_live_rows(log("vectors"), files_log, live, dead_bytes),
        uploads=ix.uploads(files_log),
    )


def _kept_upload(idx: Index) -> DataFrame:
    """The newest upload as a rejected row, if no current files row tells of it (J5 goes on after a compaction)."""
    row = F.struct(*idx.files.columns)
    newest = idx.files_log.filter(F.col("op").isin("upsert", "rejected")).select(*idx.files.columns) \
        .agg(F.max_by(row, F.struct("upload_time", "ingest_seq", "file_path")).alias("r")).filter("r is not null").select("r.*")
    return newest.join(idx.files, ["file_path", "ingest_seq"], "left_anti").select(*idx.files.columns) \
        .withColumn("op", F.lit("rejected"))


def compact(spark: SparkSession, store: str, out: str) -> None:
    """Rewrite the current views into a fresh store folder (one batch, 0),
    clustered by ``file_path`` for min/max pruning of point lookups.  Functions
    that were deleted without their file are gone for good; rows keep their sequences."""
    idx, attempt = read_index(spark, store, lists=False), _attempt()
    for name, df in (("functions", idx.functions), ("call_edges", idx.edges),
                     ("vectors", idx.vectors), ("files", idx.files.unionByName(_kept_upload(idx)))):
        _write(df.repartitionByRange("file_path").sortWithinPartitions("file_path"), out, name, 0, attempt)
    _commit(spark, out, 0, attempt)


def compact_touched(spark: SparkSession, store: str, buckets: int = 256) -> list[int]:
    """Settle the batches since the last call in the store's base; returns the rewritten buckets.

    Only buckets of ``file_path`` that hold a path of these batches are read and
    rewritten (``buckets`` counts at the first call).  Views are the same before
    and after.  The newest tombstone and clear of a path stay, so a batch with a
    smaller sequence that arrives later still finds its rows replaced.  A settled
    batch can't be written again.  Superseded folders are left to the caller.
    """
    gen, base = _attempt(), bs.open_base(spark, store)
    attempts = _attempts(spark, store, base)
    if not attempts:
        return []
    n, names = base.buckets or buckets, list(attempts.values())
    touched = sorted(r.b for r in _log(spark, store, "files", names).select(bs.bucket_of(n).alias("b")).distinct().collect())
    idx = _views(spark, store, names, base, only=touched)
    last = [c for c in idx.files_log.columns if c != "file_path"]
    files = idx.files_log.filter("op != 'rejected'").groupBy("file_path", F.expr("op = 'clear'").alias("_clear")) \
        .agg(F.max_by(F.struct(*last), "ingest_seq").alias("_r")).select("file_path", "_r.*")
    for name, df in (("functions", idx.functions), ("call_edges", idx.edges), ("vectors", idx.vectors),
                     ("files", files.unionByName(_kept_upload(idx)))):
        bs.write_rows(df, store, name, gen, n)
    bs.commit(spark, store, gen, base, n, sorted(attempts), touched)
    return touched


# -------------------------------------------------------------------- claims
def claim_sequence(spark: SparkSession, store: str, stream_id: str, micro_batch: int, now: str,
                   seq_base: int = 1_000_000) -> tuple[int, str]:
    """S3: (sequence, upload time) of a stream's micro-batch, the same ones whenever it is replayed.

    A claim is a file named by its sequence, created only if it is not there,
    so two streams never own the same one; a second file names the stream (the
    id kept in its checkpoint), the micro-batch, the sequence and the time.  A
    try that ends between the two leaves a sequence unused.  A fresh checkpoint
    is another stream and takes sequences above all earlier ones.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = f"{store.rstrip('/')}/claims"
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(folder))
    names = [f.getPath().getName() for f in fs.listStatus(hadoop.Path(folder))]
    owner, seqs = f"{stream_id}.{int(micro_batch)}", [int(n) for n in names if n.isdigit()]
    marks = [n for n in names if n.startswith(f"{owner}.")]      # <stream>.<micro-batch>.<sequence>.<time>
    if marks:
        seq, time = min(marks).split(".")[2:]
        return int(seq), time.replace("T", " ").replace("-", ":").replace("_", "-")
    seq = max(seqs, default=seq_base - 1) + 1
    while not fs.createNewFile(hadoop.Path(f"{folder}/{seq}")):  # another stream was faster
        seq += 1
    fs.createNewFile(hadoop.Path(f"{folder}/{owner}.{seq}." + now.replace("-", "_").replace(":", "-").replace(" ", "T")))
    return seq, now
