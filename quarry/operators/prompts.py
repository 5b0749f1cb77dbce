"""Prompt assembly and response parsing.

Hits are at most 20 per request, so they are gathered per request into one
small array (a bounded group) and the language vote, name list and chunk
text are computed from that array with higher-order functions: one
aggregation, no further joins.  Prompts are built by concatenating the
template's literal pieces with columns (not by chained ``replace``, which
would substitute placeholders that appear inside user code).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.functions import text as T


def template_concat(template: str, values: dict[str, Column]) -> Column:
    """``template.format(**values)`` as a column expression."""
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def gather_hits(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per request with its hits (rank, name, tags, distance, document)
    sorted by rank.  ``hits`` carries ``metadata`` and ``document``."""
    return hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"),
        F.coalesce(F.col("metadata.function_name"), F.lit("?")).alias("name"),
        F.coalesce(F.col("metadata.tags"), F.lit("")).alias("tags"),
        F.col("distance"),
        F.col("document"),
    ))).alias("hits"))


def detect_language(hits: Column) -> Column:
    """A4: struct(language, lang_tag) voted from the hits' tag strings.

    Each hit gives one vote to every language id that is a *substring* of its
    tags (so ``javascript`` also votes ``java``).  Most votes wins; ties go to
    the language seen first (by hit rank, then table order); no votes -> C++.
    """
    def has(lang):
        # one-argument lambda: Spark reads a second parameter as the index
        return lambda h: h["tags"].contains(lang)

    cands = []
    for pos, (lang, disp, tag) in enumerate(P.PROMPT_LANGUAGES):
        voters = F.filter(hits, has(lang))
        cands.append(F.struct(
            (-F.size(voters)).alias("neg_votes"),
            F.coalesce(F.array_min(F.transform(voters, lambda h: h["rank"])), F.lit(1 << 30)).alias("first"),
            F.lit(pos).alias("pos"), F.lit(disp).alias("language"), F.lit(tag).alias("lang_tag")))
    best = F.array_min(F.filter(F.array(*cands), lambda c: c["neg_votes"] < 0))
    dl, dt = P.DEFAULT_PROMPT_LANGUAGE
    return F.struct(F.coalesce(best["language"], F.lit(dl)).alias("language"),
                    F.coalesce(best["lang_tag"], F.lit(dt)).alias("lang_tag"))


def retrieved_functions(hits: Column) -> Column:
    """A5: names of the hits in rank order."""
    return F.transform(hits, lambda h: h["name"])


def format_chunks(hits: Column) -> Column:
    """``--- [i] name (similarity: 0.00) ---`` + document, blank line between."""
    text = F.array_join(F.transform(hits, lambda h: F.concat(
        F.lit("--- ["), h["rank"].cast("string"), F.lit("] "), h["name"],
        F.lit(" (similarity: "), T.format_similarity(h["distance"]), F.lit(") ---\n"),
        h["document"])), "\n\n")
    return F.when(F.size(hits) > 0, text).otherwise(F.lit(P.NO_CHUNKS_TEXT))


def with_hit_text(requests: DataFrame, gathered: DataFrame, key: str = "query_id") -> DataFrame:
    """Requests ⟕ their gathered hits, plus A4 language, A5 names, A6 chunks."""
    j = requests.join(gathered, key, "left").withColumn(
        "hits", F.coalesce("hits", F.array().cast(gathered.schema["hits"].dataType)))
    return (j.withColumn("_lang", detect_language(F.col("hits")))
             .withColumn("language", F.col("_lang.language"))
             .withColumn("lang_tag", F.col("_lang.lang_tag")).drop("_lang")
             .withColumn("retrieved_functions", retrieved_functions(F.col("hits")))
             .withColumn("code_chunks", format_chunks(F.col("hits"))))


def build_debug_prompts(df: DataFrame) -> DataFrame:
    """Needs ``query, language, lang_tag, code_chunks, findings_text``."""
    return df.withColumn("prompt", template_concat(P.DEBUG_PROMPT_TEMPLATE, {
        "language": F.col("language"), "query": F.col("query"),
        "code_chunks": F.col("code_chunks"), "static_analysis": F.col("findings_text"),
        "lang_tag": F.col("lang_tag")}))


def build_test_prompts(df: DataFrame) -> DataFrame:
    """Needs ``framework, language, lang_tag, code_chunks``."""
    return df.withColumn("framework_name", T.framework_name(F.col("framework"))) \
             .withColumn("prompt", template_concat(P.TEST_PROMPT_TEMPLATE, {
                 "language": F.col("language"), "framework": F.col("framework_name"),
                 "code_chunks": F.col("code_chunks"), "lang_tag": F.col("lang_tag")}))


def parse_debug_responses(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Query, retrieved functions, suggested fix (C6), explanation (C7),
    number of static findings."""
    r = F.col(response_col)
    return df.select(
        *[c for c in ("request_id",) if c in df.columns],
        "query", "retrieved_functions",
        T.extract_code(r).alias("suggested_fix"),
        T.extract_explanation(r).alias("explanation"),
        F.col("finding_count").alias("static_analysis_findings"))


def parse_test_responses(df: DataFrame, response_col: str = "response") -> DataFrame:
    """The code block or, when there is none, the whole response."""
    r = F.col(response_col)
    return df.select(
        *[c for c in ("request_id",) if c in df.columns],
        "function_name",
        F.coalesce(F.nullif(T.extract_code(r), F.lit("")), r).alias("unit_tests_code"),
        "framework",
        F.concat(F.lit("Generated "), F.col("framework_name"), F.lit(" tests for `"),
                 F.col("function_name"), F.lit("` ("), F.col("language"), F.lit(").")).alias("explanation"))
