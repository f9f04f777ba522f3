"""Every query of the engine that has SQL, side by side with DuckDB."""

import os

import pytest

from recordloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr([r[n] for n in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(SQL[name]).arrow().read_all())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_cdc_covers_every_byte(spark):
    got = {r["doc_id"]: r["bytes"] for r in QUERIES["cdc_chunks"](spark, SF).collect()}
    assert got == {r["doc_id"]: len(r["text"].encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] is not None}


def test_cdc_cuts_where_the_plain_loop_does(spark):
    from .test_parts import slow_cuts

    got = {r["doc_id"]: r["chunks"] for r in QUERIES["cdc_chunks"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] is not None and len(r["text"]) < 20_000}
    assert len(texts) > 50 and all(got[i] == len(slow_cuts(t.encode(), 1024)) for i, t in texts.items())


def test_predicates_reach_the_scan_only_where_visibility_allows(spark):
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan("predicate_after_visibility").splitlines() if "FileScan" in line][0]
    assert "EqualTo(event_type,click)" not in scan
    flat = [line for line in plan("lens_aggregate").splitlines() if "FileScan" in line][0]
    assert "props" not in flat and "ts:" not in flat


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_pushdown_changes_nothing(spark, pushed):
    spark.conf.set("spark.sql.parquet.filterPushdown", pushed)
    try:
        assert QUERIES["pred_conjunction"](spark, SF).count() == QUERIES["pred_conjunction"](spark, SF).distinct().count() > 0
    finally:
        spark.conf.unset("spark.sql.parquet.filterPushdown")
