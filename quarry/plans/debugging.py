"""Answer a batch of debug questions against the index.

F7 validate -> F9 empty-index check -> J5 scope -> U1 embed the questions ->
K2 top-k (per-request k, file filter) -> payload join -> A4/A5/A6 ->
J6 findings of the scoped file -> U2 prompt -> U4 complete -> U5 parse.
The only Python stages are the caller's model functions (and the numpy
scoring inside K2).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import prompts as PR
from quarry.operators import requests as RQ
from quarry.operators.inference import DEFAULT_DIM, CompleteFn, EmbedFn, complete, embed
from quarry.operators.search import attach_payload
from quarry.operators.stored_lists import StoredLists, nearest

DEBUG_TEMPERATURE = 0.1


@dataclass
class DebugBatch:
    prompts: DataFrame       # one row per valid request, with the prompt
    rejected: DataFrame      # invalid requests with error_code / error


def debug_prompts(requests: DataFrame, files: DataFrame, vectors: DataFrame,
                  findings_text: DataFrame | None = None, embed_fn: EmbedFn | None = None,
                  dim: int = DEFAULT_DIM, lists: StoredLists | None = None, uploads: DataFrame | None = None) -> DebugBatch:
    """Everything up to the prompt.  ``requests``: request_id, query,
    file_filter, top_k.  ``files``/``vectors``: current index views.  With the
    index's stored ``lists`` the search is approximate (K3), without exact (K2).
    ``uploads``: the index's uploads, so that an upload without functions is the scope of the requests after it."""
    valid, bad1 = RQ.validate_debug_requests(requests)
    valid, bad2 = RQ.require_nonempty_index(valid, vectors)
    scoped = RQ.scope_requests(valid, files if uploads is None else uploads)
    q = embed(scoped.select(F.col("request_id").alias("query_id"), "query", "scope", "top_k"),
              "query", embed_fn, dim, out_col="qvec")
    hits = nearest(q, vectors, lists, files.select("file_path", "ingest_seq"), k_col="top_k", filter_col="scope", query_vec="qvec")
    hits = attach_payload(hits, vectors)
    gathered = PR.gather_hits(hits)
    with_text = PR.with_hit_text(scoped.withColumnRenamed("request_id", "query_id"), gathered)
    if findings_text is None:
        findings_text = files.sparkSession.createDataFrame(
            [], "file_path string, findings_text string, finding_count int")
    with_f = RQ.attach_findings(with_text, findings_text)
    out = PR.build_debug_prompts(with_f).withColumnRenamed("query_id", "request_id")
    rejected = bad1.unionByName(bad2).select("request_id", "error_code", "error")
    return DebugBatch(prompts=out, rejected=rejected)


def debug_batch(requests: DataFrame, files: DataFrame, vectors: DataFrame,
                complete_fn: CompleteFn, findings_text: DataFrame | None = None,
                embed_fn: EmbedFn | None = None, dim: int = DEFAULT_DIM, lists: StoredLists | None = None,
                uploads: DataFrame | None = None):
    """(responses, rejected).  Responses have request_id, query,
    retrieved_functions, suggested_fix, explanation, static_analysis_findings."""
    b = debug_prompts(requests, files, vectors, findings_text, embed_fn, dim, lists, uploads)
    answered = complete(b.prompts, "prompt", complete_fn, temperature=DEBUG_TEMPERATURE)
    return PR.parse_debug_responses(answered), b.rejected
