"""The keyed index: files, functions, call edges and vectors (D1-D6, F10, F11,
A2, A3, K4, K5).

Storage model: every table is an append-only log keyed by ``ingest_seq`` (one
value per indexing batch).  The *current* state is a view:

* files: the newest row per ``file_path``; a tombstone (``op = 'delete'``)
  as newest row hides the file (D1, D4);
* functions, call edges, vectors: rows whose ``(file_path, ingest_seq)`` is a
  live file version (a left-semi join), so a re-upload hides everything of
  the older version (D5) and a delete cascades without touching children
  (D4).  A batch whose files rows are not written yet is invisible;
* ``op = 'clear'`` deletes the functions (and edges) of a file up to that
  sequence, without the file and its vectors (D4, second half);
* ``op = 'rejected'`` notes an upload that defined no function (F3): what the
  index holds for the path stays, but it is the latest upload (J5).

The newest-row pick is an aggregation (``max_by``), not a window, so a file
with a very long history is pre-aggregated map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.functions import text as T
from quarry.operators import graph


# ---------------------------------------------------------------- batch rows
def file_rows(files: DataFrame, functions: DataFrame, ingest_seq, upload_time) -> DataFrame:
    """Files-log rows for one batch: name, function count (A1), time, seq."""
    counts = graph.functions_per_file(functions)
    return (files.select("file_path", "file_name").join(counts, "file_path")
            .select("file_path", "file_name", "function_count",
                    _as_col(upload_time).cast("timestamp").alias("upload_time"),
                    _as_col(ingest_seq).cast("long").alias("ingest_seq"),
                    F.lit("upsert").alias("op")))


def tombstones(paths: DataFrame, ingest_seq, upload_time) -> DataFrame:
    """Files-log rows that delete ``paths``."""
    return paths.select("file_path").distinct().select(
        "file_path", F.lit(None).cast("string").alias("file_name"),
        F.lit(0).alias("function_count"),
        _as_col(upload_time).cast("timestamp").alias("upload_time"),
        _as_col(ingest_seq).cast("long").alias("ingest_seq"),
        F.lit("delete").alias("op"))


def clears(paths: DataFrame, ingest_seq, upload_time) -> DataFrame:
    """Files-log rows that delete the functions of ``paths`` but not the files (D4, second half)."""
    return tombstones(paths, ingest_seq, upload_time).withColumn("op", F.lit("clear"))


def rejected_rows(rejects: DataFrame, ingest_seq, upload_time) -> DataFrame:
    """Files-log rows of uploads that F3 turned away; they change no current view but ``uploads``."""
    return tombstones(rejects, ingest_seq, upload_time).withColumn("op", F.lit("rejected"))


def function_rows(functions: DataFrame, ingest_seq) -> DataFrame:
    """the functions table row (tags joined, 500-char body preview)."""
    return functions.select(
        "file_path", _as_col(ingest_seq).cast("long").alias("ingest_seq"),
        "function_name", "return_type", "parameters", "line_start", "line_end", "complexity",
        "tags", F.array_join("tags", ",").alias("tags_str"), "calls", "language", "open_off",
        T.vector_id(F.col("file_path"), F.col("function_name")).alias("vector_id"),
        "body",
        F.left(F.coalesce("body", F.lit("")), F.lit(P.BODY_PREVIEW_CHARS)).alias("body_preview"),
    )


def edge_rows(functions: DataFrame, ingest_seq) -> DataFrame:
    """J2 rows tagged with the batch."""
    return graph.call_edges(functions.drop("ingest_seq")).withColumn("ingest_seq", _as_col(ingest_seq).cast("long"))


def vector_metadata(fn: DataFrame) -> Column:
    """the flat metadata stored with each vector."""
    return F.struct(
        F.col("function_name").alias("function_name"), F.col("file_path").alias("file_path"),
        F.col("complexity").alias("complexity"), F.array_join("tags", ",").alias("tags"),
        F.col("line_start").alias("line_start"), F.col("line_end").alias("line_end"))


def vector_rows(functions: DataFrame, ingest_seq) -> DataFrame:
    """C4 + C5 + F11 for one batch, one row per vector id (D2: when a file
    defines a name twice, the definition with the highest ``line_start``
    wins).  The embedding is added by ``inference.embed``."""
    functions = functions.drop("ingest_seq")
    docs = functions.select(
        T.vector_id(F.col("file_path"), F.col("function_name")).alias("vector_id"),
        "file_path", "function_name", _as_col(ingest_seq).cast("long").alias("ingest_seq"),
        T.function_document(F.col("function_name"), F.col("return_type"), F.col("parameters"),
                            F.col("body"), F.col("tags")).alias("document"),
        vector_metadata(functions).alias("metadata"),
        "open_off",
    )
    # grouped by (file_path, function_name), which the extraction's file_path
    # partitioning already satisfies: no shuffle
    best = docs.groupBy("file_path", "function_name").agg(
        F.max_by(F.struct("vector_id", "ingest_seq", "document", "metadata"),
                 F.struct(F.col("metadata.line_start"), F.col("open_off"))).alias("v"))
    return best.select("v.vector_id", "file_path", "v.ingest_seq", "v.document", "v.metadata")


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --------------------------------------------------------------- current view
def _newest(log: DataFrame) -> DataFrame:
    newest = log.groupBy("file_path").agg(
        F.max_by(F.struct(*[c for c in log.columns if c != "file_path"]), "ingest_seq").alias("r"))
    return newest.select("file_path", "r.*").filter(F.col("op") == "upsert")


def current_files(files_log: DataFrame) -> DataFrame:
    """Newest row per ``file_path`` unless it is a tombstone (clears and rejected uploads leave the file as it is)."""
    return _newest(files_log.filter(F.col("op").isin("upsert", "delete")))


def uploads(files_log: DataFrame) -> DataFrame:
    """Every upload that reached extraction, indexed or rejected, also of files deleted since (for J5)."""
    return files_log.filter(F.col("op").isin("upsert", "rejected")).select("file_path", "upload_time", "ingest_seq")


def live_versions(files_log: DataFrame) -> DataFrame:
    return current_files(files_log).select("file_path", "ingest_seq")


def current_rows(child_log: DataFrame, files_log: DataFrame) -> DataFrame:
    """Children of live file versions only (cascade by construction)."""
    return child_log.join(live_versions(files_log), ["file_path", "ingest_seq"], "left_semi")


def live_function_versions(files_log: DataFrame) -> DataFrame:
    """Live file versions whose functions were not cleared since."""
    return _newest(files_log.filter(F.col("op") != "rejected").select("file_path", "ingest_seq", "op")).select("file_path", "ingest_seq")


def current_functions(child_log: DataFrame, files_log: DataFrame) -> DataFrame:
    """Functions or edges of live file versions that were not cleared since."""
    return child_log.join(live_function_versions(files_log), ["file_path", "ingest_seq"], "left_semi")


def dead_versions(files_log: DataFrame, live: DataFrame) -> DataFrame:
    """Versions that were indexed once and are not among ``live``."""
    indexed = files_log.filter(F.col("op") == "upsert").select("file_path", "ingest_seq").distinct()
    return indexed.join(live, ["file_path", "ingest_seq"], "left_anti")


def delete_by_file(vectors: DataFrame, paths: DataFrame):
    """D3: (remaining vectors, deleted count per requested path)."""
    wanted = paths.select("file_path").distinct()
    remaining = vectors.join(wanted, "file_path", "left_anti")
    counts = (vectors.join(wanted, "file_path", "left_semi").groupBy("file_path")
              .agg(F.count(F.lit(1)).alias("n")))
    deleted = (wanted.join(counts, "file_path", "left")
               .select("file_path", F.coalesce("n", F.lit(0)).cast("int").alias("deleted")))
    return remaining, deleted


def index_count(vectors: DataFrame) -> DataFrame:
    """A2: total number of indexed functions (one row)."""
    return vectors.agg(F.count(F.lit(1)).cast("long").alias("indexed_functions"))


def functions_by_file(functions: DataFrame) -> DataFrame:
    """K4: each file's functions in ``line_start`` order (``position`` from 1)."""
    w = Window.partitionBy("file_path").orderBy("line_start", "open_off")
    return functions.withColumn("position", F.row_number().over(w))


def get_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """the current rows of the named files (unknown paths give no row)."""
    return files.join(paths.select("file_path"), "file_path", "left_semi")


def latest_file(files: DataFrame) -> DataFrame:
    """K5: the most recent upload (one row; empty when there is none).

    Files of one batch share time and sequence; the largest path among them
    is taken so the answer is deterministic."""
    return files.agg(F.max_by("file_path", F.struct("upload_time", "ingest_seq", "file_path")).alias("file_path")) \
                .filter(F.col("file_path").isNotNull())


def index_summary(files: DataFrame, functions: DataFrame) -> DataFrame:
    """A3: one row per indexed file: name, count, call graph map, message."""
    from quarry.operators.languages import display_language_of

    g = graph.call_graph(functions)
    maps = g.groupBy("file_path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("function_name", "callees")))).alias("call_graph"))
    head, tail = P.INDEXED_MESSAGE.split("{n}")
    mid, tail = tail.split("{lang}")
    return (files.join(maps, "file_path", "left")
            .select("file_path", "file_name", F.col("function_count").alias("functions_indexed"),
                    F.coalesce("call_graph", F.create_map().cast("map<string,array<string>>")).alias("call_graph"),
                    F.concat(F.lit(head), F.col("function_count").cast("string"), F.lit(mid),
                             F.coalesce(display_language_of(F.col("file_name")), F.lit("None")),
                             F.lit(tail)).alias("message")))
