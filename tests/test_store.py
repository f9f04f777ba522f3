import pytest

from recordloom.control import CancellationToken, Control
from recordloom.errors import Cancelled, Contention, Erased, InvalidArgument, ResourceExhausted
from recordloom.operators import predicates as P
from recordloom.operators.content import Carve
from recordloom.operators.scan import ScanRequest, pages
from recordloom.plans.sql import SqlBudget, SqlOptions, SqlQuery
from recordloom.sources.store import Batch, Store, open_snapshot, restore, retained_commits
from recordloom.types import Value


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The golden steps: v1, then v2 with a delete."""
    s = Store.open(spark, tmp_path_factory.mktemp("golden") / "s")
    V = Value
    s.apply(
        Batch()
        .put(
            "alpha",
            [("tag", "first"), ("low", V.int(-(1 << 63))), ("float", V.bits(1 << 63)), ("on", True), ("high", V.uint((1 << 64) - 1)), ("blob", b"\0\xff"), ("at", V.timestamp_ns(-1)), ("nullable", None), ("tag", "second")],
            {"body": b"alpha body", "empty": b""},
            Carve("whole"),
        )
        .put("beta", [("kind", "old"), ("float", V.bits(0x7FF8000000000001))])
        .put("gamma", [("tag", "g"), ("count", 7)], {"body": b"0123456789"})
    )
    s.sync()
    s.flush()
    one = open_snapshot(spark, s.root)
    s.apply(Batch().put("alpha", [("tag", "new"), ("count", 2), ("nullable", None)], {"body": b"alpha body v2", "empty": b""}).delete("beta").put("delta", [("tag", "d"), ("count", 3), ("enabled", False), ("at", V.timestamp_ns(1))], {"aux": b"shared", "body": b"delta-body"}))
    overlay = [r.id for r in s.scan(ScanRequest(predicates=(P.Attr("count", "gt", V.int(2)),))).rows]
    s.flush()
    yield s, one, open_snapshot(spark, s.root), overlay
    s.close()


def ids(snap, **kw):
    return [r.id for page in pages(snap, snap._fold(), ScanRequest(**kw)) for r in page.rows]


def test_golden_queries(corpus):
    s, one, two, overlay = corpus
    assert ids(one, predicates=(P.Id("eq", "alpha"),)) == ["alpha"]
    assert ids(one, reverse=True, limit=1) == ["gamma", "beta", "alpha"]
    assert overlay == ["delta", "gamma"]
    assert ids(two, predicates=(P.Attr("nullable", "eq", Value.null()),)) == ["alpha"]
    assert ids(one, predicates=(P.ContentExists("body", False),)) == ["beta"]
    assert ids(one, predicates=(P.Attr("float", "eq", Value.bits(0x7FF8000000000001)),)) == ["beta"]
    assert ids(two, contents=(("body", "metadata"),)) == ["alpha", "delta", "gamma"]
    assert ids(two, contents=(("body", "bytes"),), max_reconstructed_bytes=5) == ["alpha", "delta", "gamma"]
    assert ids(two, start="alpha", end="gamma", reverse=True) == ["delta", "alpha"]


def test_scalars_and_order_survive(corpus):
    r = corpus[1].get("alpha")
    assert [n for n, _ in r.attrs] == ["tag", "low", "float", "on", "high", "blob", "at", "nullable", "tag"]
    assert dict(r.attrs[1:8]) == {"low": Value.int(-(1 << 63)), "float": Value.bits(1 << 63), "on": Value.bool(True), "high": Value.uint((1 << 64) - 1), "blob": Value.binary(b"\0\xff"), "at": Value.timestamp_ns(-1), "nullable": Value.null()}
    assert corpus[1].read_content("alpha") == b"alpha body"
    assert corpus[1].read_content("alpha", "empty") == b""
    assert corpus[2].get("beta") is None and corpus[2].read_content("nobody") is None


def test_cursor_is_bound_and_checked(corpus):
    two = corpus[2]
    page = two.scan(ScanRequest(limit=1))
    assert [r.id for r in page.rows] == ["alpha"]
    with pytest.raises(InvalidArgument):
        two.scan(ScanRequest(limit=1, cursor=page.next, reverse=True))
    with pytest.raises(InvalidArgument):
        two.scan(ScanRequest(limit=1, cursor=page.next[:-1] + ("0" if page.next[-1] != "0" else "1")))
    assert [r.id for r in two.scan(ScanRequest(limit=5, cursor=page.next)).rows] == ["delta", "gamma"]


def test_budgets(corpus):
    s, one, two, _ = corpus
    page = two.scan(ScanRequest(max_resolution_entries=1))
    assert [r.id for r in page.rows] == ["alpha"] and page.stats.resolution_budget_exhausted and page.stats.physical_rows == 2
    page = two.scan(ScanRequest(max_resolution_entries=2, cursor=page.next))
    assert page.rows == [] and page.stats.tombstones == 1 and page.next
    assert ids(two, max_examined=1) == ["alpha", "delta", "gamma"]
    for bad in ({"limit": 0}, {"limit": 10_001}, {"start": "b", "end": "b"}, {"contents": (("a", "bytes"), ("a", "bytes"))}):
        with pytest.raises(InvalidArgument):
            two.scan(ScanRequest(**bad))
    assert two.scan_ids("b", "b") == []
    explained = two.explain_scan(ScanRequest(start="a", end="c"))
    assert (explained.parts_considered, explained.parts_with_rows, explained.rows_in_bounds) == (2, 2, 4)


def test_float_order(spark, tmp_path):
    with Store.open(spark, tmp_path / "s") as s:
        for i, v in enumerate((-0.0, 0.0, 1.5, float("nan"))):
            s.put(f"r{i}", [("f", v)])
        f = lambda op, v: ids(s, predicates=(P.Attr("f", op, Value.float(v)),))
        assert f("eq", 0.0) == ["r1"] and f("lte", 0.0) == ["r0", "r1"] and f("gte", -0.0) == ["r0", "r1", "r2"]
        assert f("ne", 0.0) == ["r0", "r2", "r3"] and f("gt", float("nan")) == []
        assert ids(s, predicates=(P.Attr("missing", "ne", Value.int(1)),)) == []


def test_maintenance(spark, tmp_path):
    with Store.open(spark, tmp_path / "s") as s:
        for k in range(4):
            s.apply(Batch().put_body("a", b'["x",{"k":%d}]' % k).put_body(f"n{k}", b'["x"]', [("k", k)]))
            if k == 2:
                s.delete("n0")
            s.flush()
        assert s.commit.number == 4 and retained_commits(s.root) == [1, 2, 3, 4]
        assert open_snapshot(spark, s.root, 1).scan_ids() == ["a", "n0"]
        assert s.plan_compaction(max_parts=2) == (0, 2)
        out = s.merge_range(1, 2)
        assert out["superseded"] == 1 and out["tombstones_dropped"] == 0 and s.scan_ids() == ["a", "n1", "n2", "n3"]
        out = s.compact()
        assert len(s.commit.parts) == 1 and s.commit.parts[0].rows == 4
        live = s.content_liveness()
        assert live["dead_pieces"] == 3 and live["live_pieces"] == 2
        assert s.verify()["contents"] == 4
        old = s.snapshot()
        s.put_body("a", b'["x",{"k":9}]')
        s.flush()
        assert s.punch_unreferenced()["pieces"] == 4
        with pytest.raises(Erased):
            open_snapshot(spark, s.root, old.commit.number).read_content("a")
        assert s.read_content("a") == b'["x",{"k":9}]' and s.verify()
        assert s.erase_ids(["n1", "n1", "zz"]) == {"requested": 3, "tombstoned": 1, "absent": 2, "remaining": 3}
        assert s.erase_where("k", "2")["remaining"] == 2
        assert s.backup(tmp_path / "b")["contents"] == 2
    assert restore(spark, tmp_path / "b", tmp_path / "c")["contents"] == 2
    with pytest.raises(Contention):
        restore(spark, tmp_path / "b", tmp_path / "c")


def test_admission_and_control(spark, tmp_path):
    with Store.open(spark, tmp_path / "s") as s:
        with pytest.raises(Contention):
            Store.open(spark, tmp_path / "s")
        with pytest.raises(ResourceExhausted):
            s.put("x" * 5000)
        with pytest.raises(InvalidArgument):
            s.put("")
        token = CancellationToken()
        token.cancel()
        s.put("a")
        with pytest.raises(Cancelled):
            s.flush(Control(token))
        assert s.flush().rows == 1
        assert s.metrics()["operations"]["flush"]["cancelled"] == 1
        assert s.lifecycle_events_after(0)["events"]


def test_replay_after_a_crash(spark, tmp_path):
    s = Store.open(spark, tmp_path / "s")
    s.put_body("a", b"[1, 2]", [("x", 1.5)])
    s.sync()
    s.files.delete("_lock")  # the writer is gone without a flush
    with Store.open(spark, tmp_path / "s") as t:
        assert t.replay() == 1 and t.read_content("a") == b"[1, 2]"


def test_sql(corpus):
    two = corpus[2]
    q = SqlQuery(two, 'SELECT id, "count", "nullable#null" AS n FROM records WHERE "count" > $1 ORDER BY id', [2])
    assert q.schema_ipc() and [tuple(r) for r in q.df.collect()] == [("delta", 3, None), ("gamma", 7, None)]
    import pyarrow as pa

    batch = pa.ipc.open_stream(q.next()).read_all()
    assert batch.num_rows == 2 and q.next() is None and q.next() is None and q.finished
    assert SqlQuery(two, "SELECT cast(body AS string) AS b FROM t WHERE id = 'alpha'").df.collect()[0]["b"] == "alpha body v2"
    for bad in ("DROP VIEW records", "CREATE TABLE x AS SELECT 1", "SET a=b", "", "SELECT $2", "SELEC", "INSERT INTO records VALUES (1)"):
        with pytest.raises(InvalidArgument):
            SqlQuery(two, bad, [1])
    assert SqlQuery(two, "EXPLAIN SELECT 1").df.count() == 1
    budget = SqlBudget(10)
    with pytest.raises(ResourceExhausted):
        SqlQuery(two, "SELECT 1", options=SqlOptions(11), budget=budget)
    assert budget.reserved == 0


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    """One part of four files: ids and scores rise together."""
    from pyspark.sql import functions as F

    from recordloom.sources import importers, store

    kept, store.MARK = store.MARK, 64
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select(F.format_string("n%05d", "id").alias("id"), F.col("id").alias("score"), (F.col("id") / 2).alias("half"))
        rows = importers.attributes(rows, {"score": "int", "half": "float"}).select("id", "attrs", F.lit(None).cast("binary").alias("body"))
        with Store.open(spark, tmp_path_factory.mktemp("filed") / "s") as s:
            s.ingest(rows)
            yield s
    finally:
        store.MARK = kept
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def files_of(df):
    return len(df.inputFiles())


def test_reads_take_few_files(filed):
    s = filed
    assert s.commit.parts[0].files == 4 and files_of(s.versions()) == 4
    assert files_of(s._of("n00010")) == 1 and s.get("n00010").attrs[0] == ("score", Value.int(10)) and s.get("n1") is None
    assert files_of(s.versions(tests=(P.Attr("score", "gt", Value.int(2990)),))) == 1
    assert files_of(s.versions(tests=(P.Attr("half", "lt", Value.float(3.0)),))) == 1
    assert files_of(s.versions(tests=(P.Attr("half", "eq", Value.float(3.0)),))) == 4  # by bits: no order
    assert files_of(s.versions(tests=(P.Attr("score", "ne", Value.int(3)),))) == 4
    assert s.versions(tests=(P.Attr("score", "eq", Value.float(3.0)),)).isEmpty()  # no such type
    assert ids(s, predicates=(P.Attr("score", "gte", Value.int(2998)),)) == ["n02998", "n02999"]


def test_a_page_does_not_read_the_store(filed, monkeypatch):
    s, seen = filed, []
    view = s._view
    monkeypatch.setattr(s, "_view", lambda *a: seen.append(view(*a)) or seen[-1])
    assert [r.id for r in s.scan(ScanRequest(limit=5)).rows] == [f"n{k:05d}" for k in range(5)]
    assert [r.id for r in s.scan(ScanRequest(limit=5, reverse=True)).rows] == [f"n{k:05d}" for k in range(2999, 2994, -1)]
    assert s.scan_ids(limit=3, reverse=True) == ["n02999", "n02998", "n02997"]
    assert all(x.count() < 1500 for x in seen) and len(seen) == 3
    # a predicate that a first prefix doesn't answer reads on, and only then
    rare = ScanRequest(limit=1, predicates=(P.Attr("half", "eq", Value.float(1450.0)),))
    assert [r.id for r in s.scan(rare).rows] == ["n02900"] and len(seen) > 4
    assert ids(s, limit=700, start="n00100", end="n02900") == [f"n{k:05d}" for k in range(100, 2900)]
    assert ids(s, limit=700, start="n00100", end="n02900", reverse=True) == [f"n{k:05d}" for k in range(2899, 99, -1)]


def test_newer_parts_keep_zones_out(filed, spark, tmp_path):
    """A file that can't match may still hide an older version that does."""
    with Store.open(spark, tmp_path / "z") as s:
        s.put("a", [("x", 5)])
        s.flush()
        s.put("a", [("x", 1)])
        s.flush()
        test = (P.Attr("x", "gt", Value.int(3)),)
        assert ids(s, predicates=test) == []
        s.compact()
        assert ids(s, predicates=test) == [] and s.schema().attributes == (("x", ("int",)),)


def test_results_come_as_bounded_batches(filed, monkeypatch):
    import pyarrow as pa

    from recordloom.plans import sql

    q = SqlQuery(filed, "SELECT id, score AS x, half AS x FROM records WHERE score < $1 ORDER BY score", [2000])
    got = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in q])
    assert got.column_names == ["id", "x", "x"] and got.column(1).to_pylist() == list(range(2000)) and q.rows == 2000 and q.finished
    batch = pa.record_batch([pa.array(["x" * 1000] * 100), pa.array(["y" * 50_000] + ["z"] * 99)], ["a", "b"])
    monkeypatch.setattr(sql, "BATCH_BYTES", 20_000)
    parts = list(sql.bounded(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(p.nbytes <= 20_000 or p.num_rows == 1 for p in parts)
    empty = SqlQuery(filed, "SELECT id FROM records WHERE score < 0")
    assert empty.next() is None and pa.ipc.open_stream(empty.schema_ipc()).schema.names == ["id"]
    assert "Scan" in SqlQuery(filed, "SELECT count(*) FROM records").explain(analyze=True)


def test_several_contents_and_their_limits(spark, tmp_path):
    from recordloom.sources.store import WriteLimits

    with Store.open(spark, tmp_path / "s", WriteLimits(max_record_bytes=400, max_identifier_bytes=20)) as s:
        rows = spark.createDataFrame([("a", {"x": b"one", "body": b"[1, 2]"}), ("b", {}), ("c", None)], "id string, contents map<string,binary>")
        s.ingest(rows)
        assert s.read_content("a", "x") == b"one" and s.read_content("a") == b"[1, 2]" and s.scan_ids() == ["a", "b", "c"]
        assert s.schema().contents == ("body", "x") and s.verify()["contents"] == 2
        for bad in ("map('x', cast(repeat('y', 400) as binary))", "map('a name that is too long', cast('y' as binary))"):
            with pytest.raises(ResourceExhausted):
                s.ingest(spark.range(1).selectExpr("'d' as id", f"{bad} as contents"))


def test_a_stream_batch_is_published_once(spark, tmp_path):
    """Its number is in the commit that publishes it, so nothing lies between."""
    from recordloom.streaming.ingest import into

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","body":"[1]","ts":1}\n')
    with Store.open(spark, tmp_path / "s") as s:
        run = lambda ck: into(s, spark.readStream.schema("id string, body string, ts long").json(str(tmp_path / "in")), ck, once=True).awaitTermination()
        run(str(tmp_path / "ck"))
        assert len(s.commit.parts) == 1 and [n for _, n in s.commit.streams] == [0]
        # the stream loses what it knew of its progress, as after a crash before its commit
        __import__("shutil").rmtree(tmp_path / "ck" / "commits")
        run(str(tmp_path / "ck"))
        assert len(s.commit.parts) == 1
