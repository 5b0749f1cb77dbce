"""The store's attempts, claims and partial deletes, and the stored inverted file, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import stored_lists as SL
from quarry.operators.search import search_topk
from quarry.plans.debugging import debug_prompts
from quarry.plans.testgen import testgen_prompts as make_test_prompts
from quarry.sources import store
from quarry.streaming.ingest import ingest_stream

DAY = "2024-01-0{} 00:00:00"


def _cpp(*names):
    return "\n".join(f"int {n}(int x) {{ return helper(x); }}" for n in names)


def _names(df):
    return sorted((r.file_path, r.function_name) for r in df.collect())


def test_an_attempt_without_its_commit_is_not_read(spark, files_df, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store.write_index(spark, files_df([("/u/a.cpp", "a.cpp", _cpp("one", "two"))]), root, 1, DAY.format(1))

    def fails(*_):
        raise RuntimeError("the job ended here")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fails)
        with pytest.raises(RuntimeError):
            store.write_index(spark, files_df([("/u/a.cpp", "a.cpp", _cpp("new"))]), root, 1, DAY.format(2))
    before = store.read_index(spark, root)
    assert _names(before.functions) == [("/u/a.cpp", "one"), ("/u/a.cpp", "two")] and before.vectors.count() == 2
    store.write_index(spark, files_df([("/u/b.cpp", "b.cpp", _cpp("other"))]), root, 1, DAY.format(2))
    # a reader that was opened before the re-run still reads the attempt it saw
    assert _names(before.functions) == [("/u/a.cpp", "one"), ("/u/a.cpp", "two")]
    after = store.read_index(spark, root)
    assert _names(after.functions) == [("/u/b.cpp", "other")] and [r.file_path for r in after.files.collect()] == ["/u/b.cpp"]
    assert after.edges.count() == 1 and after.vectors.count() == 1


def test_only_folders_of_committed_attempts_are_read(spark, files_df, tmp_path):
    root = str(tmp_path / "store")
    for text in ("one", "two", "three"):
        store.write_index(spark, files_df([("/u/a.cpp", "a.cpp", _cpp(text))]), root, 1, DAY.format(1))
    log = store._log(spark, root, "functions", store._committed(spark, root))
    assert "attempt" in log._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert len({f.rsplit("/", 2)[1] for f in log.inputFiles()}) == 3 and log.count() == 1
    assert _names(store.read_index(spark, root).functions) == [("/u/a.cpp", "three")]


def test_a_repeated_path_counts_once(spark, files_df, tmp_path):
    root = str(tmp_path / "store")
    rows = [("/u/a.cpp", "a.cpp", _cpp("aa")), ("/u/a.cpp", "a.cpp", _cpp("zz")), ("/u/b.cpp", "b.cpp", _cpp("bb"))]
    store.write_index(spark, files_df(rows), root, 1, DAY.format(1))
    idx = store.read_index(spark, root)
    assert _names(idx.functions) == [("/u/a.cpp", "zz"), ("/u/b.cpp", "bb")]
    assert sorted((r.file_path, r.function_count) for r in idx.files.collect()) == [("/u/a.cpp", 1), ("/u/b.cpp", 1)]


def test_functions_go_and_their_file_stays(spark, files_df, tmp_path):
    root = str(tmp_path / "store")
    store.write_index(spark, files_df([("/u/a.cpp", "a.cpp", _cpp("one")), ("/u/b.cpp", "b.cpp", _cpp("two"))]), root, 1, DAY.format(1))
    store.delete_functions(spark, spark.createDataFrame([("/u/a.cpp",)], "file_path string"), root, 2, DAY.format(2))
    idx = store.read_index(spark, root)
    assert _names(idx.functions) == [("/u/b.cpp", "two")] and [r.caller for r in idx.edges.collect()] == ["two"]
    assert sorted(r.file_path for r in idx.files.collect()) == ["/u/a.cpp", "/u/b.cpp"] and idx.vectors.count() == 2
    store.write_index(spark, files_df([("/u/a.cpp", "a.cpp", _cpp("again"))]), root, 3, DAY.format(3))
    assert _names(store.read_index(spark, root).functions) == [("/u/a.cpp", "again"), ("/u/b.cpp", "two")]
    store.delete_files(spark, spark.createDataFrame([("/u/a.cpp",)], "file_path string"), root, 4, DAY.format(4))
    assert [r.file_path for r in store.read_index(spark, root).files.collect()] == ["/u/b.cpp"]


def test_claims(spark, tmp_path):
    root = str(tmp_path / "store")
    first = store.claim_sequence(spark, root, "s1", 0, DAY.format(1))
    assert first == (1_000_000, DAY.format(1))
    assert store.claim_sequence(spark, root, "s2", 0, DAY.format(2)) == (1_000_001, DAY.format(2))
    assert store.claim_sequence(spark, root, "s1", 1, DAY.format(2))[0] == 1_000_002
    assert store.claim_sequence(spark, root, "s1", 0, DAY.format(3)) == first           # a replay keeps its time, too


def test_two_streams_and_a_fresh_checkpoint_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "store")

    def ingest(folder, checkpoint):
        ingest_stream(spark, str(tmp_path / folder), root, str(tmp_path / checkpoint)).awaitTermination(180)

    for folder, name in (("in1", "x"), ("in2", "y")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}.cpp").write_text(_cpp(name))
        ingest(folder, f"ck-{folder}")
    (tmp_path / "in1" / "z.cpp").write_text(_cpp("z"))
    ingest("in1", "ck-in1")
    names = [("/uploads/x.cpp", "x"), ("/uploads/y.cpp", "y"), ("/uploads/z.cpp", "z")]
    assert _names(store.read_index(spark, root).functions) == names
    ingest("in1", "ck-fresh")                                  # everything of the folder again, under a new sequence
    assert _names(store.read_index(spark, root).functions) == names
    assert sorted({r.ingest_seq for r in store.read_index(spark, root).files.collect()}) == [1_000_001, 1_000_003]


# ------------------------------------------------------------- stored lists
def _vectors(spark, n, files=5, dim=8, seed=1, start=0, seq=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype("float32")
    m[::10] = m[0]                                             # ties
    rows = [(f"v{start + i:05d}", f"f{(start + i) % files}", seq, m[i].tolist()) for i in range(n)]
    rows[3] = (*rows[3][:3], None)
    return spark.createDataFrame(rows, "vector_id string, file_path string, ingest_seq long, embedding array<float>"), m


def _hits(df):
    return [(r.query_id, r.rank, r.vector_id, None if r.distance is None else round(r.distance, 9))
            for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("bytes_", [64 << 20, 1])
def test_all_lists_are_exact_with_filters_and_a_k_each(spark, tmp_path, bytes_):
    v, m = _vectors(spark, 300)
    q = spark.createDataFrame([(i, m[i].tolist(), [None, "f1", "f4", "none"][i % 4], 1 + i % 9) for i in range(40)]
                              + [(99, None, None, 3)], "query_id long, embedding array<float>, qf string, top_k int")
    lists = SL.StoredLists.train(v, str(tmp_path / "lists"), n_lists=7, share=1.0)
    asked = {"k_col": "top_k", "filter_col": "qf"}
    want = _hits(search_topk(q, v, **asked))
    assert _hits(lists.search(q, max_broadcast_bytes=bytes_, block_rows=16, **asked)) == want
    assert _hits(SL.StoredLists.open(spark, lists.path).search(q, **asked)) == want
    few = lists.search(q, share=0.05, max_broadcast_bytes=bytes_, block_rows=16, **asked)       # goes on until k matching ones are held
    assert few.groupBy("query_id").count().collect() and few.count() == len(want)


def test_live_versions_only(spark, tmp_path):
    old, m = _vectors(spark, 200)
    new, _ = _vectors(spark, 100, seed=2, seq=2)
    lists = SL.StoredLists.train(old, str(tmp_path / "lists"), n_lists=6, share=1.0)
    for _ in range(2):                                         # the batch again changes nothing
        lists.add(new, 2)
    both = old.unionByName(new)
    live = spark.createDataFrame([("f0", 1), ("f1", 2), ("f2", 2)], "file_path string, ingest_seq long")
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(20)], "query_id long, embedding array<float>")
    now = both.join(live, ["file_path", "ingest_seq"], "left_semi")
    assert _hits(lists.search(q, k=7, live=live)) == _hits(search_topk(q, now, k=7))
    assert lists.search(q, k=7).filter("distance is null").count() == 0


def test_lists_are_trained_anew_only_when_outgrown(spark, tmp_path, monkeypatch):
    v, _ = _vectors(spark, 60)
    lists = SL.StoredLists.train(v, str(tmp_path / "lists"), n_lists=3, share=1.0)
    assert not lists.needs_training()
    lists.add(_vectors(spark, 200, start=1000)[0], 1)
    assert lists.needs_training()
    assert SL.StoredLists.train(v.limit(0), str(tmp_path / "none")) is None
    one = SL.StoredLists.train(v, str(tmp_path / "small"), share=0.5, max_center_bytes=3 * 8 * 8)
    assert len(one.centers) == 3                               # as many lists as the limit holds; no error


def test_a_search_reads_only_the_folders_it_probes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SL, "LISTS_PER_FOLDER", 1)
    v, m = _vectors(spark, 400)
    lists = SL.StoredLists.train(v, str(tmp_path / "lists"), n_lists=10, share=0.01)
    q = spark.createDataFrame([(1, m[1].tolist())], "query_id long, embedding array<float>")
    plan = lists.search(q, k=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_lists_kept_by_the_store_answer_requests(spark, files_df, tmp_path):
    root = str(tmp_path / "store")
    text = lambda i: _cpp(*[f"fn_{i}_{j}" for j in range(6)])
    store.write_index(spark, files_df([(f"/u/f{i}.cpp", f"f{i}.cpp", text(i)) for i in range(12)]), root, 1, DAY.format(1), lists=True)
    first = store.read_index(spark, root).lists
    store.write_index(spark, files_df([("/u/f0.cpp", "f0.cpp", _cpp("changed"))]), root, 2, DAY.format(2), lists=True)
    idx = store.read_index(spark, root)
    assert idx.lists.path == first.path                        # added to, not trained again
    idx.lists.share = idx.lists.scoped_share = 1.0
    req = spark.createDataFrame([(1, "what does fn_3_2 do", "/u/f3.cpp", 4), (2, "changed", None, 5), (3, "fn_1_1", "/u/none.cpp", 2)],
                                "request_id long, query string, file_filter string, top_k int")
    exact, near = (debug_prompts(req, idx.files, idx.vectors, lists=x).prompts.select("request_id", "prompt") for x in (None, idx.lists))
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, near.collect()))
    treq = spark.createDataFrame([(1, "fn_2_1", "gtest"), (2, "changed", None)], "request_id long, function_name string, framework string")
    exact, near = (make_test_prompts(treq, idx.vectors, lists=x).prompts.select("request_id", "prompt") for x in (None, idx.lists))
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, near.collect()))


def test_registered_recall(spark):
    from quarry import queries

    for sf in ("sf0.01", "sf0.1"):
        assert all(r.recall_reached for r in queries.approx_recall(spark, f"/root/testdata/{sf}").collect())


def test_a_query_travels_once_a_block_of_lists(spark, tmp_path):
    v, m = _vectors(spark, 200)
    lists = SL.StoredLists.train(v, str(tmp_path / "lists"), n_lists=10, share=1.0)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(20)], "query_id long, embedding array<double>")
    held = {r.list_id: r["n"] for r in lists._counts().groupBy("list_id").sum("n").toDF("list_id", "n").collect()}
    asked = q.selectExpr("query_id", "embedding as qv", "cast(null as string) as qf", "4 as qk")
    probes = lists._probes(asked, lists._counts(), held, None, False)
    found = lists._in_blocks(probes, lists._rows(sorted(held)), 20, held, 200)
    assert found.count() == 20 * 4                             # the lists of a block share one cut
