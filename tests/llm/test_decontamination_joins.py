"""A benchmark above one block: the joins give what the lookup gives, on given tables and on awkward rows."""

from pyspark.sql import functions as F

from quarry.llm import decontaminate as dc
from quarry.llm.io import read
from tests.conftest import SF_SMALL


def _found(docs, bench, **how):
    got = dc.find_contamination(docs, bench, into="found", **how)
    return sorted(map(str, got.select("doc_id", "found.*").collect()))


def test_joins_equal_the_lookup_on_given_tables(spark):
    docs, bench = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "benchmark")
    looked_up = _found(docs, bench)
    assert _found(docs, bench, block_bytes=1) == looked_up
    assert any("items=['" in r for r in looked_up)


def test_joins_on_awkward_rows(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [None, "", " .,; ", "na " * 20_000, "x " + passage + " y", passage.upper(), "é1 ÉTÉ two", "one, two! three"] + ["a " + passage] * 50
    docs = spark.createDataFrame([(i, t, "old", t) for i, t in enumerate(texts)], "doc_id long, text string, found string, i string")
    items = [(1, passage), (1, passage), (2, "na " * 30), (None, "one two"), (3, None), (4, ""), (5, "étÉ"), (6, "p1 " * 2)]
    bench = spark.createDataFrame([(i, t, "more") for i, t in items], "item_id long, text string, key string")
    got = dc.find_contamination(docs, bench, into="found", block_bytes=1)
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == len(texts)
    rows = {r.doc_id: r.found for r in got.collect()}
    assert rows[0].n_words == rows[1].n_words == rows[2].n_words == 0 and not rows[0].spans and rows[0].items == []
    assert rows[3].spans == [0, 20_000] and rows[3].items == ["2"]
    assert rows[4].spans == [1, 41] and rows[5].spans == [0, 40] and rows[4].items == ["1"]
    assert rows[7].spans == [0, 2] and rows[7].items == [""]
    assert all(rows[i].spans == [1, 41] for i in range(8, 58))
    assert _found(docs, bench, block_bytes=1) == _found(docs, bench)
    assert _found(docs.limit(0), bench, block_bytes=1) == []


def test_a_large_benchmark_stays_on_the_executors(spark, monkeypatch):
    docs, bench = read(spark, SF_SMALL, "documents").select("doc_id", "text"), read(spark, SF_SMALL, "benchmark")
    monkeypatch.setattr(dc, "_scanner", None)                              # the driver builds no table of items
    got = dc.find_contamination(docs, bench, block_bytes=1)
    assert got.filter(F.size("contamination.items") > 0).count() > 0
