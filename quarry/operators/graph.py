"""Call graph, edges and per-file counts.

Everything is keyed by ``file_path`` (a file's calls only resolve inside the
file), so these are equi-joins and aggregations on small metadata rows; the
function bodies are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_definitions(functions: DataFrame) -> DataFrame:
    """One row per (file, name): the definition that comes last in the file."""
    return functions.groupBy("file_path", "function_name").agg(
        F.max_by("calls", "open_off").alias("calls"),
        F.max_by("line_start", "open_off").alias("line_start"),
    )


def call_edges(functions: DataFrame) -> DataFrame:
    """One row per (caller, callee name); external callees included."""
    return functions.select(
        "file_path", F.col("function_name").alias("caller"),
        F.col("line_start").alias("caller_line"),
        F.explode("calls").alias("callee_name"),
    )


def call_graph(functions: DataFrame) -> DataFrame:
    """For each function name, its calls that are functions of the same
    file (sorted); duplicate names keep the last definition; no internal
    calls -> empty list.

    One pass, no self-join: each (last) definition row explodes into one
    "defines name" row and one row per call; a window over (file, name)
    tells whether a called name is defined in the file; one aggregation
    gathers the internal callees.  Everything is clustered by ``file_path``,
    so after the extraction it needs no shuffle.
    """
    last = last_definitions(functions)
    ev = last.select("file_path", "function_name", F.explode(F.concat(
        F.array(F.struct(F.col("function_name").alias("key"), F.lit(True).alias("is_def"))),
        F.transform("calls", lambda c: F.struct(c.alias("key"), F.lit(False).alias("is_def"))))).alias("e"))
    w = Window.partitionBy("file_path", "e.key")
    marked = ev.select("file_path", "function_name", "e.key", "e.is_def",
                       F.max(F.col("e.is_def").cast("int")).over(w).alias("defined"))
    return marked.groupBy("file_path", "function_name").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_def") & (F.col("defined") == 1), F.col("key"))))
         .alias("callees"))


def functions_per_file(functions: DataFrame) -> DataFrame:
    """A1: number of extracted functions per file."""
    return functions.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("function_count"))


def functions_by_name(functions: DataFrame, names: DataFrame) -> DataFrame:
    """The first function with each requested name, smallest
    (file_path, line_start) first (the reference's LIMIT 1 has no order).

    ``names`` has a ``function_name`` column.  The place of the pick is an
    aggregation over four columns that combines map-side, so a name that many
    files define leaves each task as one row; the names are matched on the
    picks, and only then the functions at those places are fetched, by a key
    that holds the file, so no name is a hot key and no body is sorted.
    Functions are told apart by (file_path, line_start, open_off).
    """
    place = ["file_path", "line_start", "open_off"]
    first = functions.groupBy("function_name").agg(
        F.min("file_path").alias("file_path"), F.min_by(F.struct("line_start", "open_off"), F.struct(*place)).alias("_at")) \
        .join(names.select("function_name"), "function_name", "left_semi").select("function_name", "file_path", "_at.*")
    others = [c for c in functions.columns if c != "function_name"]
    return functions.join(first, ["function_name", *place], "left_semi").select("function_name", *others)
