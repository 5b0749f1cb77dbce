"""Compaction of touched buckets: the same views as a store that is never compacted, and only changed buckets written."""

import os

import pytest

from quarry.sources import base as bs
from quarry.sources import store
from quarry.streaming.ingest import ingest_stream

DAY = "2024-01-0{} 00:00:00"
VIEWS = ("files", "functions", "edges", "vectors")


def _cpp(*names):
    return "\n".join(f"int {n}(int x) {{ return helper(x); }}" for n in names)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _paths(spark, *names):
    return spark.createDataFrame([(f"/u/{n}.cpp",) for n in names], "file_path string")


def _files(files_df, names, *functions):
    return files_df([(f"/u/{n}.cpp", f"{n}.cpp", _cpp(*[n + f for f in functions])) for n in names])


def _same(spark, a, b):
    a, b = store.read_index(spark, a), store.read_index(spark, b)
    for name in VIEWS:
        assert _rows(getattr(a, name)) == _rows(getattr(b, name)), name
    newest = lambda idx: idx.uploads.orderBy("upload_time", "ingest_seq", "file_path", ascending=False).first()
    assert newest(a) == newest(b)
    return a


def _written(root, table, gen):
    folder = os.path.join(root, "base", table, f"gen={gen}")
    return sorted(int(d.split("=")[1]) for d in os.listdir(folder) if d.startswith("bucket="))


def test_views_stay_and_only_touched_buckets_are_written(spark, files_df, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "store")
    both = (log, root)
    for r in both:
        store.write_index(spark, _files(files_df, "abcdefgh", "1", "2"), r, 1, DAY.format(1))
        store.delete_files(spark, _paths(spark, "b"), r, 2, DAY.format(2))
    first = store.compact_touched(spark, root, buckets=16)
    idx = _same(spark, log, root)
    assert len(idx.files.collect()) == 7 and store.compact_touched(spark, root) == []

    for r in both:
        store.write_index(spark, _files(files_df, "a", "9"), r, 3, DAY.format(3))
        store.delete_functions(spark, _paths(spark, "c"), r, 4, DAY.format(4))
        store.delete_files(spark, _paths(spark, "d"), r, 5, DAY.format(5))
        store.write_index(spark, files_df([("/u/z.cpp", "z.cpp", "// nothing")]), r, 6, DAY.format(6))
    _same(spark, log, root)                                               # base and later batches together
    before = bs.open_base(spark, root)
    touched = store.compact_touched(spark, root, buckets=999)             # the number of buckets is the first call's
    after = bs.open_base(spark, root)
    want = _paths(spark, "a", "c", "d", "z").select(bs.bucket_of(16).alias("b")).distinct().collect()
    assert touched == sorted(r.b for r in want) and 0 < len(touched) < len(first)
    assert after.buckets == 16 and after.settled == {1, 2, 3, 4, 5, 6} and after.newest != before.newest
    for table in ("files", "functions", "call_edges", "vectors"):
        assert set(_written(root, table, after.newest)) <= set(touched)
    _same(spark, log, root)

    # rows of settled batches come from the base's current buckets only
    rows = bs.base_rows(spark, root, "functions", store.SCHEMAS["functions"], after)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store._committed(spark, root) == []
    store.write_index(spark, _files(files_df, "b", "new"), root, 7, DAY.format(7))
    store.write_index(spark, _files(files_df, "b", "new"), log, 7, DAY.format(7))
    _same(spark, log, root)
    out = str(tmp_path / "fresh")
    store.compact(spark, root, out)                                       # a rewrite reads the base, too
    _same(spark, log, out)


def test_late_batches_do_not_bring_rows_back(spark, files_df, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "store")
    for r in (log, root):
        store.write_index(spark, _files(files_df, "ab", "1"), r, 1, DAY.format(1))
        store.delete_files(spark, _paths(spark, "a"), r, 9, DAY.format(4))
        store.delete_functions(spark, _paths(spark, "b"), r, 8, DAY.format(3))
    store.compact_touched(spark, root, buckets=4)
    for r in (log, root):
        store.write_index(spark, _files(files_df, "ab", "late"), r, 5, DAY.format(2))
    idx = _same(spark, log, root)
    assert [r.file_path for r in idx.files.collect()] == ["/u/b.cpp"] and idx.functions.count() == 0
    store.compact_touched(spark, root)
    _same(spark, log, root)


def test_failed_and_concurrent_compactions(spark, files_df, tmp_path, monkeypatch):
    log, root = str(tmp_path / "log"), str(tmp_path / "store")
    for r in (log, root):
        store.write_index(spark, _files(files_df, "abc", "1"), r, 1, DAY.format(1))

    def fails(*_):
        raise RuntimeError("the job ended here")
    with monkeypatch.context() as m:
        m.setattr(bs, "commit", fails)
        with pytest.raises(RuntimeError):
            store.compact_touched(spark, root, buckets=4)
    assert bs.open_base(spark, root).newest == ""
    _same(spark, log, root)

    # another compaction from the same start, committed in between with a later name: one of the two counts
    commit = bs.commit

    def overtaken(*args):
        m.undo()
        for r in (log, root):
            store.write_index(spark, _files(files_df, "d", "1"), r, 2, DAY.format(2))
        store.compact_touched(spark, root, buckets=8)
        commit(*args)
    m = pytest.MonkeyPatch()
    m.setattr(bs, "commit", overtaken)
    store.compact_touched(spark, root, buckets=4)
    base = bs.open_base(spark, root)
    assert base.buckets == 4 and base.settled == {1}                      # the smaller name; batch 2 is read from its log
    _same(spark, log, root)
    store.compact_touched(spark, root)
    assert bs.open_base(spark, root).settled == {1, 2}
    _same(spark, log, root)


def test_settled_batches_are_not_written_again(spark, files_df, tmp_path):
    root = str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.cpp").write_text(_cpp("x"))
    ingest_stream(spark, str(tmp_path / "in"), root, str(tmp_path / "ck")).awaitTermination(180)
    store.compact_touched(spark, root, buckets=4)
    assert store.is_settled(spark, root, 1_000_000) and not store.is_settled(spark, root, 1)
    for write in (store.delete_files, store.delete_functions):
        with pytest.raises(ValueError, match="new batch"):
            write(spark, _paths(spark, "x"), root, 1_000_000, DAY.format(1))
    with pytest.raises(ValueError, match="new batch"):
        store.write_index(spark, _files(files_df, "x", "1"), root, 1_000_000, DAY.format(1))
    assert [r.function_name for r in store.read_index(spark, root).functions.collect()] == ["x"]


def test_a_store_of_deletes_only(spark, tmp_path):
    root = str(tmp_path / "store")
    store.delete_files(spark, _paths(spark, "a"), root, 1, DAY.format(1))
    assert len(store.compact_touched(spark, root, buckets=4)) == 1
    idx = store.read_index(spark, root)
    assert [getattr(idx, name).count() for name in VIEWS] == [0, 0, 0, 0]
