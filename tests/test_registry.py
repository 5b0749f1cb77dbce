"""Every registered query against its DuckDB twin on the smallest tables
(the same comparison the driver makes at sf0.01)."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.oracles import oracle_sql
from quarry.queries import queries
from quarry.session import TABLES
from conftest import SF_SMALL

QUERIES = entry.queries()
SQL = entry.oracle_sql()


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def _digest(rows):
    h = hashlib.sha256()
    for r in sorted(rows):
        h.update(("\x1f".join(r) + "\x1e").encode())
    return h.hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = {"approx_topk", "approx_topk_label"}          # their recall is approx_recall
    assert set(queries()) - set(oracle_sql()) == rows_only
    assert set(SQL) <= set(QUERIES) and set(queries()) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test data missing")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    assert cols == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(srows) == _digest(drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["file_path", "function_name", "line_start", "line_end", "complexity", "tags",
                          "file_findings"]


def test_a_query_writes_only_the_index_logs_it_reads(spark, tmp_path):
    from quarry import queries

    spark.createDataFrame([(i, "red ring", "Brand#1", "PROMO", i % 30) for i in range(20)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int") \
        .write.parquet(str(tmp_path / "part.parquet"))
    assert queries.index_files(spark, str(tmp_path)).count() > 0
    key = (spark.sparkContext.applicationId, str(tmp_path))
    assert list(queries._INDEX_LOGS[key][1]) == ["files"]
    assert queries.index_count(spark, str(tmp_path)).first()[0] > 0
    assert list(queries._INDEX_LOGS[key][1]) == ["files", "vectors"]
