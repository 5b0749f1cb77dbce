"""Static findings on C/C++ sources.

The rules are per line (``gets(``, ``strcpy(``) and per file (``new`` without
``delete``, ``fopen`` without ``fclose``).  ``analyze`` evaluates all of them
inside the file's own row with higher-order array functions, so it needs no
shuffle at all: a file's findings come out in the reference's order and
``posexplode`` numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.operators.languages import is_analyzable

FINDING_SCHEMA = "struct<type:string,line:int,severity:string,detail:string>"


def lines_of(src: Column) -> Column:
    """Lines as ``std::getline`` yields them: split on ``\\n``, no empty line
    after a final newline, none at all for an empty file."""
    s = F.coalesce(src, F.lit(""))
    body = F.when(s.endswith("\n"), F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def code_lines(files: DataFrame) -> DataFrame:
    """L1: one row per line, ``line_no`` from 1."""
    return files.select("file_path", F.posexplode(lines_of(F.col("source_code"))).alias("pos", "line")) \
                .select("file_path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def _finding(type_, line, severity, detail) -> Column:
    return F.struct(F.lit(type_).alias("type"), line.cast("int").alias("line"),
                    F.lit(severity).alias("severity"), F.lit(detail).alias("detail"))


def findings_of(src: Column) -> Column:
    """L2 + L3 + D6 for one file, as an ordered array of finding structs."""
    s = F.coalesce(src, F.lit(""))

    def per_line(line, i):
        return F.array_compact(F.array(*[
            F.when(line.contains(needle), _finding(t, i + 1, sev, det))
            for needle, t, sev, det in P.LINE_RULES
        ]))

    line_hits = F.flatten(F.transform(lines_of(s), per_line))
    has_new = s.rlike(P.P_NEW_SPARK)
    mem = F.when(has_new & ~s.contains("delete"), _finding(*P.MEMORY_LEAK[:1], F.lit(0), *P.MEMORY_LEAK[1:]))
    res = F.when(s.contains("fopen") & ~s.contains("fclose"),
                 _finding(*P.RESOURCE_LEAK[:1], F.lit(0), *P.RESOURCE_LEAK[1:]))
    return F.concat(line_hits, F.array_compact(F.array(mem, res))).cast(f"array<{FINDING_SCHEMA}>")


def analyze(files: DataFrame) -> DataFrame:
    """L4: findings of the analyzable files, ``seq`` from 1 in report order."""
    return (files.filter(is_analyzable(F.col("file_path")))
            .select("file_path", F.posexplode(findings_of(F.col("source_code"))).alias("pos", "f"))
            .select("file_path", (F.col("pos") + 1).cast("int").alias("seq"),
                    "f.type", "f.line", "f.severity", "f.detail"))


def finding_counts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Number of findings per file, 0 when none (partial aggregation first)."""
    counts = findings.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return (files.select("file_path").join(counts, "file_path", "left")
            .select("file_path", F.coalesce("n", F.lit(0)).cast("int").alias("finding_count")))


def _finding_line(f: Column) -> Column:
    return F.concat(F.lit("- ["), F.upper(f["severity"]), F.lit("] Line "), f["line"].cast("string"),
                    F.lit(": "), f["detail"])


def format_findings_column(findings: Column) -> Column:
    """L6 on an ordered findings array: prompt text, empty when there are none."""
    body = F.array_join(F.transform(findings, _finding_line), "\n")
    text = F.concat(F.lit(P.FINDINGS_HEADING + "\n\n"), body, F.lit("\n\n" + P.FINDINGS_FOOTER))
    return F.when(F.size(findings) > 0, text).otherwise(F.lit(""))


def format_findings(findings: DataFrame) -> DataFrame:
    """L6 on a findings table: one prompt text per file that has findings.

    Only the small finding rows are grouped; order comes from ``seq``.
    """
    grouped = findings.groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "type", "line", "severity", "detail"))).alias("fs"))
    return grouped.select("file_path", format_findings_column(F.col("fs")).alias("findings_text"))
