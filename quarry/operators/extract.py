"""Function extraction (X1-X5): one pass over each file, inside its own row.

Plan shape: scan -> Arrow batches of whole files through the bracket reader
(``functions.headers``) -> one row per function with its body -> calls,
complexity and tags as built-in expressions.  No step orders, joins or shuffles
source text: a file's functions depend on that file alone, so the work spreads
as the files do and a lost task re-reads only its own files.  A caller that
needs no bodies (counts, line ranges) asks for spans, and then none are cut or
sent back.

Semantics kept from the scanner being reproduced: brackets in strings and
comments count; an unclosed body runs to the end of the file; nested headers are
emitted too; names ``if while for switch catch`` are skipped; files of no known
language use the scanner's own header pattern.  C and C++ (qualified names,
destructors, constructors with initialiser lists, operators, ``const noexcept
override``, trailing return types), Java, JavaScript, TypeScript, Go, Rust, PHP,
Python and Ruby have readers of their own.

A null path gives no function a name to be found by, but its functions are
extracted; a null text is empty; repeated rows give repeated functions.

Known limits: a brace in a member initialiser (``a_{a}``) or in a return type
cuts the header before it; K&R parameter declarations are not headers.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import headers as H
from quarry.functions import patterns as P
from quarry.functions import text as T
from quarry.operators.languages import language_of
from quarry.session import ship_package

FLUSH = 4 << 20                     # characters of results that go back in one batch
_SPANS = pa.schema([("file_path", pa.string()), ("function_name", pa.string()), ("return_type", pa.string()),
                    ("parameters", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()),
                    ("open_off", pa.int64()), ("language", pa.string())])
_FUNCTIONS = _SPANS.append(pa.field("body", pa.string()))
_PAIRS = pa.schema([("file_path", pa.string()), ("pos", pa.int32()), ("level", pa.int32()), ("open_off", pa.int64()),
                    ("close_off", pa.int64()), ("open_line", pa.int32()), ("close_line", pa.int32())])
_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def brace_segments(files: DataFrame, keep=()) -> DataFrame:
    """One row per piece of a file, each starting at a brace."""
    return files.select(
        "file_path", *keep,
        F.posexplode(F.regexp_extract_all(F.coalesce("source_code", F.lit("")),
                                          F.lit(P.P_SEGMENT), 0)).alias("pos", "seg"),
    )


def _per_file(batches, rows_of, schema):
    """Batches of ``rows_of(path, language, text)`` for every file, of bounded size."""
    held, size = [], 0
    for batch in batches:
        for path, lang, src in zip(*(batch.column(i) for i in range(3))):
            for row in rows_of(path.as_py(), lang.as_py(), src.as_py() or ""):
                held.append(row)
                size += 64 + (len(row[-1]) if isinstance(row[-1], str) else 0)
                if size > FLUSH:
                    yield _batch(held, schema)
                    held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _functions_of(path, lang, src, bodies):
    if lang in P.INDENT_LANGUAGES:
        found = [(h, start, end, end) for h, start, end in H.indented(src, lang)]
    else:
        found = [(h, at, len(src) if close is None else close + 1, len(src) if close is None else close)
                 for h, at, close in H.braced(src, lang)]
    if not found:
        return
    lines = H.Lines(src)
    for h, start, stop, last in found:
        row = (path, h.name, h.return_type, h.parameters, lines.of(h.start), lines.of(last), start, lang)
        yield (*row, src[start:stop]) if bodies else row


def _pairs_of(path, lang, src):
    lines = H.Lines(src)
    for pos, level, at, close in H.brace_pairs(src):
        yield path, pos, level, at, close, lines.of(at), None if close is None else lines.of(close)


def _scan(files: DataFrame, rows_of, schema: pa.Schema) -> DataFrame:
    ship_package(files.sparkSession)
    lang = F.coalesce(language_of(F.substring_index("file_path", "/", -1)), F.lit("unknown"))
    return files.select("file_path", lang.alias("lang"), "source_code").mapInArrow(
        partial(_per_file, rows_of=rows_of, schema=schema), _ddl(schema))


def brace_match(files: DataFrame) -> DataFrame:
    """Every ``{`` with its matching ``}`` (NULL when unclosed): file_path, pos (number of its piece),
    level, open_off (0-based), close_off, open_line, close_line."""
    return _scan(files, _pairs_of, _PAIRS)


def function_spans(files: DataFrame) -> DataFrame:
    """X3-X5 without bodies: name, return type, parameters, lines, offset and language of every function."""
    return _scan(files, partial(_functions_of, bodies=False), _SPANS)


def extract_functions(files: DataFrame) -> DataFrame:
    """Functions with name, return type, parameters, body and line range,
    plus calls (C1), complexity (C2) and tags (C3).

    ``files`` needs ``file_path`` and ``source_code``.  The language comes from
    the file name, as for an upload (``unknown`` for unsupported names).
    """
    return _scan(files, partial(_functions_of, bodies=True), _FUNCTIONS).select(
        "*",
        T.find_calls(F.col("body")).alias("calls"),
        T.complexity(F.col("body")).alias("complexity"),
        T.make_tags(F.col("function_name"), F.col("body"), F.col("language")).alias("tags"),
    )
