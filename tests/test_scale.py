"""What a query costs follows its input: no pass too many, no single task for all."""


import json
import os

from pyspark.sql import functions as F

from recordloom import stored
from recordloom.operators import content, resolve
from recordloom.operators.content import Carve
from recordloom.sources import importers
from recordloom.sources.store import Store, open_snapshot
from recordloom.types import Value, attr_arrays

SF = "/root/testdata/sf0.001"


def test_events_are_resolved_in_one_pass(spark, tmp_path, monkeypatch):
    """No ingest of a part goes back to the events themselves."""
    seen = []
    monkeypatch.setattr(Store, "ingest", lambda self, rows, *a, **k: seen.append((rows.inputFiles(), rows.count(), rows.select("id").distinct().count())))
    with Store.open(spark, tmp_path / "s") as s:
        stored._events(spark, SF, s)
    assert len(seen) == stored.PARTS and all(n == ids > 0 for _, n, ids in seen)
    assert not [f for files, _, _ in seen for f in files if "events.parquet" in f]


def test_candidates_keep_every_newest(spark):
    rows = [(1, k, k) for k in range(50)] + [(1, 49, 100), (2, None, 0), (2, 3, 1), (3, None, 2), (None, 7, 3), (None, 6, 4)]
    table = spark.createDataFrame(rows, "id long, seq long, x long")
    kept = resolve.candidates(table)
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, 49, 49), (1, 49, 100), (2, 3, 1), (3, None, 2), (None, 7, 3)]))
    of = lambda t: sorted((repr(r["id"]), repr(r["seq"])) for r in resolve.newest(t).collect())
    assert of(kept) == of(table)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "Window" not in plan


def test_json_lines_keep_their_places_over_files_and_splits(spark, tmp_path):
    """In a folder whose files are read the largest first, in several splits each."""
    want, line, place = [], 0, 0
    for name, n in (("a", 40), ("b", 900), ("c", 3), ("d", 400)):
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            for k in range(n):
                good = k % 7 != 3
                f.write(json.dumps({"body": f"{name}{k}"}) if good else "{}")
                f.write("\n\n" if k % 11 == 0 else "\n")
                want.append((line, f"import:{place:09d}" if good else None, f"{name}{k}" if good else None, not good))
                line, place = line + 1, place + good
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = importers.jsonl(spark, str(tmp_path))
        assert sorted((r["line"], r["id"], r["body"], r["skipped"]) for r in rows.collect()) == want
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Window" not in plan and "Pandas" not in plan


def test_json_lines_are_written_by_more_than_one_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(importers, "jsonl", lambda spark, at, own=importers.jsonl: seen.append(at) or own(spark, at))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert stored.import_jsonl(spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(seen[0].removeprefix("file://")) if f.startswith("part-")]) > 1


def test_attributes_as_columns(spark):
    """The same structs as one by one."""
    from recordloom.types import ATTR

    values = [Value.str("x"), Value.int(-5), Value.float(-0.0), Value.float(float("nan")), Value.bits(0x7FF8000000000001), Value.bool(True), Value.uint((1 << 64) - 1), Value.binary(b"\0"), Value.timestamp_ns(7), Value.null()]
    records = [[(f"a{i}", v) for i, v in enumerate(values)], None, [], [("b", Value.int(1)), ("b", Value.int(2))]]
    plain = spark.createDataFrame([(None if r is None else [v.row(n) for n, v in r],) for r in records], f"attrs {_ddl(ATTR)}").collect()
    assert repr([r["attrs"].as_py() for r in _rows(attr_arrays(records))]) == repr([None if r["attrs"] is None else [{k: bytes(x) if isinstance(x, bytearray) else x for k, x in a.asDict().items()} for a in r["attrs"]] for r in plain])


def _ddl(struct):
    return f"array<{struct.simpleString()}>"


def _rows(array):
    return [{"attrs": x} for x in array]


def test_an_ingest_asks_for_its_table_once(spark, tmp_path, monkeypatch):
    """However many contents; and no piece's bytes are sorted or shuffled for the fold."""
    bodies = {f"r{i:03d}": {"a": b"[1, 22, %d]" % i, "b": b"", "c": bytes([255, i]) * 9} for i in range(120)}
    asked, plans = spark.sparkContext.accumulator(0), []

    def told(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    table = spark.createDataFrame([(i, {n: bytearray(x) for n, x in c.items()}) for i, c in bodies.items()], "id string, contents map<string,binary>")
    write = Store._write_fold
    monkeypatch.setattr(Store, "_write_fold", lambda self, pieces, gen: plans.append(pieces._jdf.queryExecution().executedPlan().toString()) or write(self, pieces, gen))
    with Store.open(spark, tmp_path / "s") as s:
        s.ingest(table.mapInArrow(told, table.schema))
        assert asked.value == len(bodies)
        s.ingest(table.select(F.concat(F.lit("again-"), "id").alias("id"), "contents"))
        assert len(s.commit.folds) == 1 and s.dedup["dedup_hits"] == s.dedup["pieces"] - s.fold().count()
        got = {n: {r["id"]: bytes(r["body"]) for r in s.contents(n).collect()} for n in "abc"}
    assert got == {n: {p + i: c[n] for p in ("", "again-") for i, c in bodies.items()} for n in "abc"}
    assert not any("SortAggregate" in p for p in plans)
    assert open_snapshot(spark, s.root).verify()["contents"] == 6 * len(bodies)


def test_bodies_of_one_piece_are_not_put_together(spark):
    """Only those of several are grouped; what comes out is the same."""
    texts = [b"", b"x" * 40, "à".encode() * 3, bytes(range(256)), None]
    table = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "id int, body binary")
    for how in (Carve("whole"), Carve("inline"), Carve("cdc", 64)):
        cut = content.carved(table.withColumn("seq", F.col("id")), how).localCheckpoint()
        fold = content.novel(content.pieces(cut), None)
        made = cut.where("body is not null").select("id", content.digest(F.col("body")).alias("identity"), content.ops(F.col("body"), F.col("spans")).alias("ops"))
        built = content.reconstruct(made, fold, ["id"])
        assert {r["id"]: bytes(r["body"]) for r in built.collect()} == {i: t for i, t in enumerate(texts) if t is not None}
    plan = content.reconstruct(made, fold, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") >= 1 and "hex(" not in [line for line in plan.splitlines() if "collect_list" in line][-1].partition("unhex")[0]


def test_a_backlog_is_not_sorted_whole(spark, tmp_path, monkeypatch):
    """Of a stream's batch only rows that may stand reach the window."""
    from recordloom.streaming.ingest import into

    plans, ingest = [], Store.ingest
    monkeypatch.setattr(Store, "ingest", lambda self, rows, *a, **k: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or ingest(self, rows, *a, **k))
    rows = [("a", b"[%d]" % k, k) for k in range(300)] + [("b", None, None), ("c", b"[7]", 1), ("c", b"[8]", None)]
    table = spark.createDataFrame([(i, b and bytearray(b), ts) for i, b, ts in rows], "id string, body binary, ts long")
    table.write.parquet(str(tmp_path / "in"))
    with Store.open(spark, tmp_path / "s") as s:
        for _ in range(2):
            into(s, spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), once=True).awaitTermination()
        assert len(plans) == len(s.commit.parts) == 1 and "LeftSemi" in plans[0]
        assert (s.read_content("a"), s.exists("b"), s.read_content("c")) == (b"[299]", True, b"[7]")
