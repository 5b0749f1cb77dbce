"""F7-F9, J5, J6, A4-A6, U1-U6, E2, E3."""

from pyspark.sql import functions as F

from quarry.operators import prompts as PR
from quarry.operators import requests as RQ
from quarry.plans.debugging import debug_batch
from quarry.plans.indexing import index_batch
from quarry.plans import testgen

HIT = "query_id long, rank int, distance double, document string, metadata struct<function_name:string,tags:string>"


def _vote(spark, tag_lists):
    rows = [(1, i + 1, 0.1, "doc", (f"f{i}", t)) for i, t in enumerate(tag_lists)]
    hits = spark.createDataFrame(rows, HIT) if rows else spark.createDataFrame([], HIT)
    req = spark.createDataFrame([(1,)], "query_id long")
    out = PR.with_hit_text(req, PR.gather_hits(hits)).first()
    return out.language, out.lang_tag, out.code_chunks


def test_language_vote(spark):
    assert _vote(spark, ["sort,javascript", "java"])[:2] == ("Java", "java")
    assert _vote(spark, ["python", "go"])[:2] == ("Python", "python")
    assert _vote(spark, ["go", "python"])[:2] == ("Go", "go")
    assert _vote(spark, ["graph", ""])[:2] == ("C++", "cpp")
    assert _vote(spark, []) == ("C++", "cpp", "No relevant code found.")


def test_chunks_text(spark):
    assert _vote(spark, ["graph"])[2] == "--- [1] f0 (similarity: 0.90) ---\ndoc"


def test_debug_validation(spark):
    req = spark.createDataFrame([(1, "q", 0), (2, "q", 1), (3, "q", 20), (4, "q", 21), (5, "q", None), (6, None, 3)],
                                "request_id long, query string, top_k int")
    ok, bad = RQ.validate_debug_requests(req)
    assert sorted((r.request_id, r.top_k) for r in ok.collect()) == [(2, 1), (3, 20), (5, 5)]
    assert sorted((r.request_id, r.error_code) for r in bad.collect()) == [(1, 422), (4, 422), (6, 422)]


def test_test_validation(spark):
    req = spark.createDataFrame([(1, "f", None), (2, "f", "gtest"), (3, "f", "pytest")],
                                "request_id long, function_name string, framework string")
    ok, bad = RQ.validate_test_requests(req)
    assert sorted((r.request_id, r.framework) for r in ok.collect()) == [(1, "catch2"), (2, "gtest")]
    assert [(r.request_id, r.error_code, r.error) for r in bad.collect()] == \
        [(3, 400, "Invalid framework. Use 'catch2' or 'gtest'")]


def test_empty_index_rejects_everything(spark):
    req = spark.createDataFrame([(1, "q", 5)], "request_id long, query string, top_k int")
    empty = spark.createDataFrame([], "vector_id string")
    ok, bad = RQ.require_nonempty_index(req, empty)
    assert ok.count() == 0 and bad.first().error_code == 400


def _make_embed_fn():
    # nested, so cloudpickle ships it by value to the Python workers
    def embed_fn(texts):                      # a caller-supplied embedder (U1)
        return [[float(t.count("dijkstra")), float(t.count("sort")), 1.0] for t in texts]
    return embed_fn


embed_fn = _make_embed_fn()


def _index(spark, files_df):
    files = files_df([
        ("/uploads/g.cpp", "g.cpp", "int dijkstra(int s) { return relax(s); }\nint relax(int e) { return e; }"),
        ("/uploads/s.py", "s.py", "def quick_sort(a):\n    return merge(a)\n"),
    ])
    b = index_batch(files, 1, "2024-01-01 00:00:00", embed_fn=embed_fn)
    return ix_files(b), b.vectors


def ix_files(b):
    from quarry.operators.index import current_files
    return current_files(b.files)


def test_debug_and_tests_end_to_end_with_caller_functions(spark, files_df):
    files, vectors = _index(spark, files_df)

    seen = []

    def complete_fn(prompts, params):         # a caller-supplied model (U4)
        seen.append(params["temperature"])
        return [f"## Root Cause\nx\n```cpp\nfix_{i}();\n```\n## Explanation\n because  " for i, _ in enumerate(prompts)]

    req = spark.createDataFrame([(1, "dijkstra is slow", "/uploads/g.cpp", 2), (2, "sort", "", 1)],
                                "request_id long, query string, file_filter string, top_k int")
    out, bad = debug_batch(req, files, vectors, complete_fn, embed_fn=embed_fn)
    rows = {r.request_id: r for r in out.collect()}
    assert bad.count() == 0
    assert rows[1].retrieved_functions == ["dijkstra", "relax"]
    assert rows[1].suggested_fix.startswith("fix_") and rows[1].explanation == "because"
    # request 2 has an empty filter -> scoped to the latest upload (largest path of the batch)
    assert rows[2].retrieved_functions == ["quick_sort"]

    treq = spark.createDataFrame([(7, "quick_sort", "gtest")], "request_id long, function_name string, framework string")
    tout, tbad = testgen.tests_batch(treq, vectors, lambda ps, p: ["no fence here" for _ in ps], embed_fn=embed_fn)
    t = tout.first()
    assert t.unit_tests_code == "no fence here" and t.framework == "gtest"
    assert t.explanation == "Generated Google Test tests for `quick_sort` (Python)."
