"""Request batches: validation, empty-index check, scoping.

Requests are DataFrames (a batch of questions), never loops.  Rejected rows
come back as a DataFrame with ``error_code`` and ``error``; nothing raises.
Index-wide facts (is the index empty, which file was uploaded last) are
scalar subqueries, so they stay lazy and are computed once per plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.operators.index import latest_file
from quarry.operators.languages import is_analyzable


def _split(df: DataFrame, error) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("_err", error)
    valid = tagged.filter(F.col("_err").isNull()).drop("_err")
    rejected = tagged.filter(F.col("_err").isNotNull()) \
                     .withColumn("error_code", F.col("_err.code")) \
                     .withColumn("error", F.col("_err.msg")).drop("_err")
    return valid, rejected


def _err(code: int, msg: str):
    return F.struct(F.lit(code).alias("code"), F.lit(msg).alias("msg"))


def validate_debug_requests(req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``top_k`` defaults to 5 and must be 1..20; ``query`` is required."""
    req = req.withColumn("top_k", F.coalesce(F.col("top_k").cast("int"), F.lit(P.DEFAULT_TOP_K)))
    error = (F.when(F.col("query").isNull(), _err(422, "query: Field required"))
             .when(F.col("top_k") < 1, _err(422, "top_k: Input should be greater than or equal to 1"))
             .when(F.col("top_k") > P.MAX_TOP_K,
                   _err(422, f"top_k: Input should be less than or equal to {P.MAX_TOP_K}")))
    return _split(req, error)


def validate_test_requests(req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F8: ``framework`` defaults to catch2 and must be catch2 or gtest."""
    req = req.withColumn("framework", F.coalesce(F.col("framework"), F.lit("catch2")))
    error = (F.when(F.col("function_name").isNull(), _err(422, "function_name: Field required"))
             .when(~F.col("framework").isin(*P.ACCEPTED_FRAMEWORKS), _err(400, P.BAD_FRAMEWORK_MESSAGE)))
    return _split(req, error)


def require_nonempty_index(req: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """with zero indexed functions every request is rejected (400)."""
    n = vectors.limit(1).agg(F.count(F.lit(1))).scalar()
    return _split(req, F.when(n == 0, _err(400, P.EMPTY_INDEX_MESSAGE)))


def rejects(req: DataFrame, vectors: DataFrame, validate) -> DataFrame:
    """The requests that F7 or F8 (``validate``) or F9 turns away, without the search."""
    valid, invalid = validate(req)
    _, unanswerable = require_nonempty_index(valid, vectors)
    return invalid.unionByName(unanswerable).select("request_id", "error_code", "error")


def scope_requests(req: DataFrame, files: DataFrame, filter_col: str = "file_filter") -> DataFrame:
    """A missing or empty filter becomes the most recently uploaded file of ``files`` (current files, or
    ``index.uploads`` with rejected ones); with no file uploaded the request stays unfiltered (``scope`` NULL)."""
    latest = latest_file(files).select("file_path").scalar()
    return req.withColumn("scope", F.coalesce(F.nullif(F.col(filter_col), F.lit("")), latest))


def attach_findings(req: DataFrame, findings_text: DataFrame, scope_col: str = "scope") -> DataFrame:
    """Requests carry the formatted findings (and their number) of their
    scoped file when it is analyzable; otherwise empty text and 0.

    ``findings_text``: ``file_path, findings_text, finding_count``.
    """
    ft = findings_text.select(F.col("file_path").alias("_fp"), "findings_text", "finding_count")
    joined = req.join(ft, (F.col(scope_col) == F.col("_fp")) & is_analyzable(F.col(scope_col)), "left")
    return joined.drop("_fp").withColumn("findings_text", F.coalesce("findings_text", F.lit(""))) \
                 .withColumn("finding_count", F.coalesce("finding_count", F.lit(0)).cast("int"))
