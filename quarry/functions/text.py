"""Column expressions on code and response text.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen and run next to the scan; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import patterns as P


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def strip(col: Column) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace, newlines included)."""
    return F.regexp_replace(col, P.P_STRIP, "")


def lstrip(col: Column) -> Column:
    return F.regexp_replace(col, P.P_LSTRIP, "")


def find_calls(body: Column) -> Column:
    """Distinct identifiers directly followed by ``(``, minus keywords, sorted."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(P.P_CALL), 1)
    return F.array_sort(F.array_except(found, _lit_array(P.CALL_SKIP_NAMES)))


def complexity(body: Column) -> Column:
    """1 + number of branch keyword tokens and ``?`` characters."""
    return (F.lit(1) + F.regexp_count(F.coalesce(body, F.lit("")), F.lit(P.P_COMPLEXITY))).cast("int")


def make_tags(name: Column, body: Column, lang: Column) -> Column:
    """Substring rules on lower(name + body), then the language unless C/C++."""
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.coalesce(body, F.lit(""))))
    parts = []
    for tag, needles in P.TAG_RULES:
        cond = None
        for n in needles:
            c = text.contains(n)
            cond = c if cond is None else (cond | c)
        parts.append(F.when(cond, F.lit(tag)))
    parts.append(F.when(~lang.isin(*P.UNTAGGED_LANGUAGES), lang))
    return F.array_compact(F.array(*parts))


def function_document(name: Column, ret: Column, params: Column, body: Column,
                      tags: Column) -> Column:
    """C4: the text that is embedded for a function."""
    tag_str = F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(F.lit("general"))
    doc = F.concat(
        F.lit("\nFunction: "), name,
        F.lit("\nSignature: "), ret, F.lit(" "), name, F.lit("("), params, F.lit(")"),
        F.lit("\nTags: "), tag_str,
        F.lit("\nCode:\n"), body, F.lit("\n"),
    )
    return strip(doc)


def vector_id(file_path: Column, name: Column) -> Column:
    """``file_path::function_name``."""
    return F.concat(file_path, F.lit("::"), name)


def extract_code(response: Column) -> Column:
    """First fenced block, stripped; empty string when there is none."""
    return strip(F.regexp_extract(F.coalesce(response, F.lit("")), P.P_FENCE, 1))


def extract_explanation(response: Column) -> Column:
    """Text after the first ``## Explanation``, stripped; else the response.

    ``substring_index(.., -1)`` would cut at the last marker, so the position
    of the first one is used instead.
    """
    marker = "## Explanation"
    pos = F.instr(response, marker)
    return F.when(pos > 0, strip(F.substr(response, pos + F.lit(len(marker))))).otherwise(response)


def framework_name(code: Column) -> Column:
    """Display name of a test framework, or the code itself."""
    keys = F.array(*[F.lit(k) for k, _ in P.FRAMEWORK_NAMES])
    vals = F.array(*[F.lit(v) for _, v in P.FRAMEWORK_NAMES])
    idx = F.array_position(keys, code).cast("int")
    return F.when(idx > 0, F.element_at(vals, idx)).otherwise(code)


def format_similarity(distance: Column) -> Column:
    """``f"{1 - distance:.2f}"`` with Python's half-even rounding."""
    sim = F.lit(1).cast("double") - F.coalesce(distance, F.lit(1.0))
    rounded = F.bround(sim.cast("decimal(38,18)"), 2)
    return rounded.cast("decimal(38,2)").cast("string")
