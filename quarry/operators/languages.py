"""Language detection and upload validation.

The extension table is 16 fixed entries, so lookups are literal CASE
expressions (no join, no broadcast) that stay inside the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P


def _lookup(key: Column, pairs) -> Column:
    """Lookup in a small fixed table held as two array literals (NULL when
    absent).  Array literals compare equal when plans are canonicalised
    (map literals do not), so exchanges below a language filter can still
    be reused, and the expression stays small for code generation."""
    keys = F.array(*[F.lit(k) for k, _ in pairs])
    vals = F.array(*[F.lit(v) for _, v in pairs])
    idx = F.array_position(keys, key).cast("int")
    return F.when(idx > 0, F.element_at(vals, idx))


def last_extension(name: Column) -> Column:
    """Lower-cased ``.ext`` after the last dot, or NULL when there is no dot."""
    low = F.lower(name)
    return F.when(F.instr(low, ".") > 0, F.concat(F.lit("."), F.substring_index(low, ".", -1)))


def language_of(name: Column) -> Column:
    """Language id for a file name (NULL when unsupported)."""
    return _lookup(last_extension(name), [(e, lang) for e, lang, _ in P.EXTENSION_TABLE])


def display_language_of(name: Column) -> Column:
    return _lookup(last_extension(name), [(e, disp) for e, _, disp in P.EXTENSION_TABLE])


def display_name_of_language(lang: Column) -> Column:
    return _lookup(lang, sorted({(lang_, disp) for _, lang_, disp in P.EXTENSION_TABLE}))


def with_language(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """add ``lang`` and ``display_lang`` (NULL for unsupported files)."""
    return files.withColumn("lang", language_of(F.col(name_col))) \
                .withColumn("display_lang", display_language_of(F.col(name_col)))


def split_supported(files: DataFrame, name_col: str = "file_name"):
    """(accepted, rejected); rejects carry ``error_code`` 400 and the message."""
    tagged = with_language(files, name_col)
    accepted = tagged.filter(F.col("lang").isNotNull())
    msg = P.UNSUPPORTED_MESSAGE.replace("{exts}", ", ".join(P.SUPPORTED_EXTENSIONS))
    head, tail = msg.split("{name}")
    rejected = (tagged.filter(F.col("lang").isNull())
                .select("file_path", name_col,
                        F.lit(400).alias("error_code"),
                        F.concat(F.lit(head), F.col(name_col), F.lit(tail)).alias("error")))
    return accepted, rejected


def split_empty(files: DataFrame, functions: DataFrame):
    """files without any extracted function are rejected with 422.

    Both sides are keyed by ``file_path``; only the distinct paths of the
    functions table take part in the semi/anti joins.
    """
    paths = functions.select("file_path").distinct()
    accepted = files.join(paths, "file_path", "left_semi")
    head, tail = P.NO_FUNCTIONS_MESSAGE.split("{lang}")
    rejected = (files.join(paths, "file_path", "left_anti")
                .select("file_path", F.lit(422).alias("error_code"),
                        F.concat(F.lit(head), F.coalesce(F.col("display_lang"), F.lit("None")),
                                 F.lit(tail)).alias("error")))
    return accepted, rejected


def path_suffix(path: Column) -> Column:
    """Python ``PurePath(path).suffix.lower()``: '' for no dot, a leading-dot
    name or a trailing dot."""
    name = F.substring_index(path, "/", -1)
    pos = F.length(name) - F.length(F.substring_index(name, ".", -1))
    return F.when((pos > 1) & (pos < F.length(name)), F.lower(F.substr(name, pos))).otherwise(F.lit(""))


def is_analyzable(path: Column) -> Column:
    """the static analyzer runs on .cpp .c .h .hpp .cc only (not .cxx)."""
    return path_suffix(path).isin(*P.ANALYZABLE_EXTENSIONS)


def analyzable(files: DataFrame, path_col: str = "file_path") -> DataFrame:
    return files.filter(is_analyzable(F.col(path_col)))
