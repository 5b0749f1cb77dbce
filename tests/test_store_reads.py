"""Reading the index without shuffling bodies and vectors, rejected uploads, and the model stages' columns."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import requests as RQ
from quarry.operators.inference import PerTask, complete, embed
from quarry.plans.debugging import debug_prompts
from quarry.sources import store

DAY = "2024-01-0{} 00:00:00"


def _cpp(*names):
    return "\n".join(f"int {n}(int x) {{ return helper(x); }}" for n in names)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def root(spark, files_df, tmp_path):
    """Four batches: three files, one again, one deleted, one cleared."""
    root = str(tmp_path / "store")
    names = [(f"/u/{n}.cpp", f"{n}.cpp", _cpp(n + "1", n + "2")) for n in "abc"]
    store.write_index(spark, files_df(names), root, 1, DAY.format(1))
    store.write_index(spark, files_df([("/u/a.cpp", "a.cpp", _cpp("again"))]), root, 2, DAY.format(2))
    store.delete_files(spark, spark.createDataFrame([("/u/b.cpp",)], "file_path string"), root, 3, DAY.format(3))
    store.delete_functions(spark, spark.createDataFrame([("/u/c.cpp",)], "file_path string"), root, 4, DAY.format(4))
    return root


def test_dead_versions_travel_to_the_children(spark, root):
    near, far = store.read_index(spark, root), store.read_index(spark, root, dead_bytes=-1)
    assert sorted(r.function_name for r in near.functions.collect()) == ["again"]
    assert sorted(r.metadata.function_name for r in near.vectors.collect()) == ["again", "c1", "c2"]
    for name in ("functions", "edges", "vectors"):
        a, b = getattr(near, name), getattr(far, name)
        assert _rows(a) == _rows(b)
        plan = a._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "Exchange hashpartitioning" not in plan


def test_a_rejected_upload_is_the_latest_and_changes_nothing_else(spark, files_df, root, tmp_path):
    before = store.read_index(spark, root)
    store.write_index(spark, files_df([("/u/a.cpp", "a.cpp", "// nothing here"), ("/u/z.md", "z.md", "x")]), root, 5, DAY.format(5))
    idx = store.read_index(spark, root)
    for name in ("files", "functions", "edges", "vectors"):
        assert _rows(getattr(idx, name)) == _rows(getattr(before, name))
    req = spark.createDataFrame([(1, "q", None, 5), (2, "q", "/u/c.cpp", 5)], "request_id long, query string, file_filter string, top_k int")
    scopes = {r.request_id: r.scope for r in RQ.scope_requests(req, idx.uploads).collect()}
    assert scopes == {1: "/u/a.cpp", 2: "/u/c.cpp"}                       # an unsupported file is no upload
    assert ix.latest_file(idx.files).first().file_path == "/u/a.cpp" and ix.latest_file(before.files).first().file_path == "/u/a.cpp"
    hits = debug_prompts(req, idx.files, idx.vectors, uploads=idx.uploads).prompts.filter("request_id = 1").first()
    assert hits.retrieved_functions == ["again"]

    store.write_index(spark, files_df([("/u/new.cpp", "new.cpp", "int x = 1;")]), root, 6, DAY.format(6))
    out = str(tmp_path / "compact")
    store.compact(spark, root, out)
    for path in (root, out):                                              # a path that the index never held
        got = store.read_index(spark, path)
        assert {r.scope for r in RQ.scope_requests(req.filter("request_id = 1"), got.uploads).collect()} == {"/u/new.cpp"}
        assert sorted(r.file_path for r in got.files.collect()) == ["/u/a.cpp", "/u/c.cpp"]
        assert _rows(got.vectors) == _rows(before.vectors)


def test_model_stages_take_one_column_and_start_once_a_task(spark):
    rows = [(i, f"text {i}" if i % 3 else None, "w" * 50) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string, wide string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        def client():
            import uuid
            me = uuid.uuid4().hex                                         # one name for each start
            return lambda prompts, params: [f" {me}|{p} " for p in prompts]

        got = complete(df, "text", PerTask(client), 0.1)
        plan = got._jdf.queryExecution().executedPlan().toString()
        arguments = plan.split("ArrowEvalPython [")[1].split("]")[0]
        assert "text" in arguments and "wide" not in arguments
        found = got.withColumn("task", F.spark_partition_id()).collect()
        assert len(found) == 500 and len({r.response.split("|")[0] for r in found}) == len({r.task for r in found})
        assert all(r.response.split("|")[1] == (r.text or "").strip() for r in found)

        vectors = embed(df, "text", PerTask(lambda: lambda texts: [[float(len(t)), 0.5] for t in texts])).collect()
        assert all(r.embedding == [float(len(r.text or "")), 0.5] and r.wide == "w" * 50 for r in vectors)
        with pytest.raises(Exception, match="returned 0 vectors"):
            embed(df, "text", lambda texts: []).collect()
        blank = embed(df.limit(4).withColumn("text", F.lit(None).cast("string")), "text", dim=4).collect()
        assert [r.embedding for r in blank] == [[0.0] * 4] * 4
        assert embed(df.limit(0), "text", dim=4).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
