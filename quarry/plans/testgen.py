"""Generate unit tests for a batch of function names.

F8 validate -> F9 empty-index check -> U1 embed the *name* -> K2 top-3 over
the whole index (no file filter; the request's file id is ignored, as in the
reference) -> A4/A6 -> C9 framework name -> U3 prompt -> U4 complete -> U6.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.operators import prompts as PR
from quarry.operators import requests as RQ
from quarry.operators.inference import DEFAULT_DIM, CompleteFn, EmbedFn, complete, embed
from quarry.operators.search import attach_payload
from quarry.operators.stored_lists import StoredLists, nearest

TEST_TEMPERATURE = 0.2


@dataclass
class TestGenBatch:
    prompts: DataFrame
    rejected: DataFrame


def testgen_prompts(requests: DataFrame, vectors: DataFrame, embed_fn: EmbedFn | None = None,
                 dim: int = DEFAULT_DIM, lists: StoredLists | None = None) -> TestGenBatch:
    """``requests``: request_id, function_name, framework.  With stored
    ``lists`` the search is approximate (K3) over the file versions of ``vectors``."""
    valid, bad1 = RQ.validate_test_requests(requests)
    valid, bad2 = RQ.require_nonempty_index(valid, vectors)
    q = embed(valid.select(F.col("request_id").alias("query_id"), "function_name"),
              "function_name", embed_fn, dim, out_col="qvec")
    live = vectors.select("file_path", "ingest_seq").distinct() if lists is not None else None
    hits = nearest(q, vectors, lists, live, k=P.TEST_TOP_K, query_vec="qvec")
    gathered = PR.gather_hits(attach_payload(hits, vectors))
    with_text = PR.with_hit_text(valid.withColumnRenamed("request_id", "query_id"), gathered)
    out = PR.build_test_prompts(with_text).withColumnRenamed("query_id", "request_id")
    rejected = bad1.unionByName(bad2).select("request_id", "error_code", "error")
    return TestGenBatch(prompts=out, rejected=rejected)


def tests_batch(requests: DataFrame, vectors: DataFrame, complete_fn: CompleteFn,
                embed_fn: EmbedFn | None = None, dim: int = DEFAULT_DIM, lists: StoredLists | None = None):
    """(responses, rejected); responses have request_id, function_name,
    unit_tests_code, framework, explanation."""
    b = testgen_prompts(requests, vectors, embed_fn, dim, lists)
    answered = complete(b.prompts, "prompt", complete_fn, temperature=TEST_TEMPERATURE)
    return PR.parse_test_responses(answered), b.rejected
