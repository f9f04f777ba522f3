"""The store's operators as queries: each runs the store itself (ingest, scan, SQL,
compaction, erasure, verification …) on one filled from the test tables, in the
shared folder, beside the SQL that says what must come out.

``events`` become versions of users in four parts (the newest of a user within each
part; ``error`` deletes), ``documents`` records with a body stored whole, and
``conversations`` bodies that grow by a turn at a time, cut by message."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import types as RT
from .errors import LoomError
from .operators import content, introspect, predicates, resolve
from .operators.content import Carve
from .operators.scan import ScanRequest, pages
from .plans.sql import SqlQuery
from .sources import importers, store
from .sources.files import Files
from .sources.store import Store, open_snapshot
from .streaming.ingest import into
from .types import Value

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PARTS = 4
_FILLED: dict[tuple[str, str, str], str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# the filled stores, one of each a session


def _filled(spark: SparkSession, d: str, what: str) -> str:
    """Where the store is; filled when it is first asked for."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _FILLED or not Files(spark, _FILLED[key]).exists("_commits"):
        at = f"{scratch.shared_dir(spark)}/store-of-{what}-{scratch.fresh_dir(spark, 'x').rpartition('-')[2]}"
        with Store.open(spark, at) as s:
            _FILL[what](spark, d, s)
        _FILLED[key] = at
    return _FILLED[key]


def _copy(spark: SparkSession, d: str, what: str) -> str:
    """A store of its own, for a query that changes it."""
    source = Files(spark, _filled(spark, d, what))
    at = scratch.fresh_dir(spark, f"copy-of-{what}")
    source.copy([n for n, _ in source.sizes() if not n.rpartition("/")[2].startswith(".")], at)
    return at


def _events(spark: SparkSession, d: str, s: Store) -> None:
    e = _t(spark, d, "events")
    top = e.agg(F.max("event_id")).first()[0] or 0
    e = e.select("user_id", "event_id", "event_type", "value", F.expr(f"event_id * {PARTS} div {top + 1}").alias("part"))
    with scratch.scope(spark):
        # all parts in one pass over the events, before attributes are made of them
        e = scratch.written(resolve.newest(resolve.candidates(e, ["user_id", "part"], "event_id"), ["user_id", "part"], "event_id"), "newest")
        e = e.withColumn("tomb", F.col("event_type") == "error").withColumn("id", F.format_string("user/%08d", "user_id"))
        typed = importers.attributes(e, {"event_type": "str", "value": "float", "event_id": "int"})
        for k in range(PARTS):
            s.ingest(typed.where(F.col("part") == k).select("id", "attrs", "tomb", F.lit(None).cast("binary").alias("body")))


def _documents(spark: SparkSession, d: str, s: Store) -> None:
    x = _t(spark, d, "documents").select(F.format_string("doc/%012d", "doc_id").alias("id"), "lang", "n_chars", F.encode("text", "UTF-8").alias("body"))
    s.ingest(importers.attributes(x, {"lang": "str", "n_chars": "int"}).select("id", "attrs", "body"), Carve("whole"))


def _conversations(spark: SparkSession, d: str, s: Store) -> None:
    from .queries import _turns

    s.ingest(_turns(spark, d).select(F.format_string("conv/%08d/%06d", "conv_id", "turn").alias("id"), "body"))


_FILL = {"events": _events, "documents": _documents, "conversations": _conversations}

# the same in SQL
_SLICED = f"SELECT *, CAST(event_id * {PARTS} // (SELECT max(event_id) + 1 FROM events) AS INTEGER) AS part FROM events"
_VERSIONS = f"SELECT printf('user/%08d', user_id) AS id, part, max(event_id) AS event_id FROM ({_SLICED}) GROUP BY 1, 2"
_NEWEST = "SELECT printf('user/%08d', user_id) AS id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"
_LIVE = f"SELECT * FROM ({_NEWEST}) WHERE event_type <> 'error'"
_ID = "printf('doc/%012d', doc_id)"


def _events_of(rows: DataFrame) -> DataFrame:
    return rows.select("id", predicates.first_occurrence("event_id", 1)["i"].alias("event_id"))


def _one(spark: SparkSession, schema: str, *values: Any) -> DataFrame:
    return spark.createDataFrame([values], schema)


def _page(spark: SparkSession, snap: Any, **request: Any) -> DataFrame:
    return spark.createDataFrame([(r.id,) for r in snap.scan(ScanRequest(**request)).rows], "id string")


# versions, snapshots, point reads


@query(f"SELECT id, event_id FROM ({_LIVE})")
def store_live_records(spark, d):
    return _events_of(open_snapshot(spark, _filled(spark, d, "events")).records())


@query(f"SELECT count(*) AS physical_rows, CAST(count(*) - count(DISTINCT id) AS BIGINT) AS superseded_rows, (SELECT count(*) FROM ({_NEWEST}) WHERE event_type = 'error') AS tombstones, (SELECT count(*) FROM ({_LIVE})) AS live_rows FROM ({_VERSIONS})")
def store_resolution(spark, d):
    return resolve.statistics(open_snapshot(spark, _filled(spark, d, "events")).versions())


@query(f"SELECT printf('user/%08d', user_id) AS id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ({_SLICED}) WHERE part < 2) WHERE rn = 1 AND event_type <> 'error'")
def snapshot_at_commit(spark, d):
    """An older commit is still there as it was: with the first two parts."""
    root = _filled(spark, d, "events")
    return _events_of(open_snapshot(spark, root, store.retained_commits(root, spark)[-3]).records())


@query("SELECT commit_number FROM (VALUES (1), (2), (3), (4)) t(commit_number)")
def retained_commits(spark, d):
    return spark.createDataFrame([(n,) for n in store.retained_commits(_filled(spark, d, "events"), spark)], "commit_number int")


@query(f"""SELECT id, CAST((SELECT event_id FROM ({_LIVE}) l WHERE l.id = a.id) AS BIGINT) AS event_id, EXISTS (SELECT 1 FROM ({_LIVE}) l WHERE l.id = a.id) AS present
 FROM (SELECT min(id) AS id FROM ({_LIVE}) UNION ALL SELECT max(id) FROM ({_VERSIONS}) UNION ALL SELECT 'user/none') a""")
def store_point_get(spark, d):
    snap = open_snapshot(spark, _filled(spark, d, "events"))
    ids = [snap.scan_ids(limit=1)[0], snap.versions().agg(F.max("id")).first()[0], "user/none"]
    got = [(i, snap.get(i), snap.exists(i)) for i in ids]
    return spark.createDataFrame([(i, next(v.raw for n, v in r.attrs if n == "event_id") if r else None, e) for i, r, e in got], "id string, event_id long, present boolean")


@query(f"SELECT {_ID} AS id, sha256(text) AS body_sha256 FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL UNION SELECT max(doc_id) FROM documents WHERE text IS NOT NULL)")
def store_point_content(spark, d):
    import hashlib

    snap = open_snapshot(spark, _filled(spark, d, "documents"))
    ends = snap.records().where("size(contents) > 0").agg(F.min("id"), F.max("id")).first()
    return spark.createDataFrame([(i, hashlib.sha256(snap.read_content(i)).hexdigest()) for i in dict.fromkeys(ends)], "id string, body_sha256 string")


# scans


@query(f"SELECT id FROM ({_LIVE}) ORDER BY id LIMIT 100")
def scan_forward(spark, d):
    return _page(spark, open_snapshot(spark, _filled(spark, d, "events")), limit=100)


@query(f"SELECT id FROM ({_LIVE}) WHERE id >= 'user/00000010' AND id < 'user/00000900' ORDER BY id DESC LIMIT 100")
def scan_reverse(spark, d):
    return _page(spark, open_snapshot(spark, _filled(spark, d, "events")), limit=100, reverse=True, start="user/00000010", end="user/00000900")


@query(f"SELECT id FROM ({_LIVE}) WHERE id >= 'user/00000010' ORDER BY id LIMIT 40")
def scan_ids(spark, d):
    return spark.createDataFrame([(i,) for i in open_snapshot(spark, _filled(spark, d, "events")).scan_ids("user/00000010", limit=40)], "id string")


@query(f"SELECT id FROM ({_LIVE}) ORDER BY id LIMIT 20 OFFSET 20")
def page_second(spark, d):
    snap, first = open_snapshot(spark, _filled(spark, d, "events")), ScanRequest(limit=20)
    cursor = snap.scan(first).next
    return _page(spark, snap, limit=20, cursor=cursor) if cursor else spark.createDataFrame([], "id string")


@query(f"SELECT id FROM (SELECT id, sum(count(*)) OVER (ORDER BY id) AS run, row_number() OVER (ORDER BY id) AS k FROM ({_VERSIONS}) GROUP BY id) WHERE (run <= 60 OR k = 1) AND id IN (SELECT id FROM ({_LIVE}))")
def page_resolution_budget(spark, d):
    return _page(spark, open_snapshot(spark, _filled(spark, d, "events")), limit=10_000, max_resolution_entries=60)


@query(f"SELECT id FROM (SELECT id, event_type, row_number() OVER (ORDER BY id) AS k FROM ({_LIVE})) WHERE k <= 30 AND event_type = 'click'")
def page_examined_budget(spark, d):
    test = predicates.Attr("event_type", "eq", Value.str("click"))
    return _page(spark, open_snapshot(spark, _filled(spark, d, "events")), limit=10_000, max_examined=30, predicates=(test,))


@query(f"SELECT id FROM (SELECT {_ID} AS id, sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id) AS run, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE run <= 100000 OR k = 1 ORDER BY id LIMIT 10000")
def page_byte_budget(spark, d):
    return _page(spark, open_snapshot(spark, _filled(spark, d, "documents")), limit=10_000, max_examined=1_000_000, contents=(("body", "bytes"),), max_reconstructed_bytes=100_000)


@query(f"SELECT id, event_id FROM ({_LIVE}) WHERE value > 50 AND event_type <> 'view' AND id < 'user/00000300'")
def scan_all_pages(spark, d):
    """Every page, each from the cursor of the one before."""
    snap = open_snapshot(spark, _filled(spark, d, "events"))
    tests = (predicates.Attr("value", "gt", Value.float(50.0)), predicates.Attr("event_type", "ne", Value.str("view")))
    rows = [r for p in pages(snap, None, ScanRequest(predicates=tests, end="user/00000300", limit=40, max_examined=100)) for r in p.rows]
    return spark.createDataFrame([(r.id, next(v.raw for n, v in r.attrs if n == "event_id")) for r in rows], "id string, event_id long")


@query(f"SELECT {PARTS} AS parts_considered, count(DISTINCT part) AS parts_with_rows, count(*) AS rows_in_bounds FROM ({_VERSIONS}) WHERE id >= 'user/00000010' AND id < 'user/00000060'")
def explain_scan(spark, d):
    x = open_snapshot(spark, _filled(spark, d, "events")).explain_scan(ScanRequest(start="user/00000010", end="user/00000060"))
    return _one(spark, "parts_considered int, parts_with_rows long, rows_in_bounds long", x.parts_considered, x.parts_with_rows, x.rows_in_bounds)


@query(f"SELECT (SELECT count(*) FROM ({_LIVE}) WHERE id IN (SELECT id FROM ({_LIVE}) ORDER BY id LIMIT 25)) AS returned, count(*) AS physical_rows, CAST(count(*) - count(DISTINCT id) AS BIGINT) AS superseded_rows FROM ({_VERSIONS}) WHERE id <= (SELECT max(id) FROM (SELECT id FROM ({_LIVE}) ORDER BY id LIMIT 25))")
def scan_statistics(spark, d):
    s = open_snapshot(spark, _filled(spark, d, "events")).scan(ScanRequest(limit=25)).stats
    return _one(spark, "returned long, physical_rows long, superseded_rows long", s.returned, s.physical_rows, s.superseded_rows)


# lens and SQL


@query(f"SELECT id, event_id, event_type, value FROM ({_LIVE})")
def store_lens(spark, d):
    return open_snapshot(spark, _filled(spark, d, "events")).lens()


@query("SELECT name, type FROM (VALUES ('event_id', 'int'), ('event_type', 'str'), ('value', 'float')) t(name, type)")
def store_schema(spark, d):
    s = open_snapshot(spark, _filled(spark, d, "events")).schema()
    return spark.createDataFrame([(n, t) for n, ts in s.attributes for t in ts], "name string, type string")


def _fetched(spark: SparkSession, q: SqlQuery) -> DataFrame:
    """All batches of a query, as they come over the wire."""
    got = [pa.ipc.open_stream(b).read_all() for b in q]
    whole = pa.concat_tables(got) if got else q.schema.empty_table()
    return spark.createDataFrame([tuple(r.values()) for r in whole.to_pylist()], q.df.schema)


@query(f"SELECT event_type, count(*) AS n, CAST(round(sum(value * 100)) AS BIGINT) AS cents FROM ({_LIVE}) WHERE event_id > 500 AND event_type <> 'view' GROUP BY 1")
def sql_params(spark, d):
    text = "SELECT event_type, count(*) AS n, cast(round(sum(value * 100)) AS bigint) AS cents FROM records WHERE event_id > $1 AND event_type <> $2 GROUP BY event_type"
    return _fetched(spark, SqlQuery(open_snapshot(spark, _filled(spark, d, "events")), text, [500, "view"]))


@query(f"SELECT {_ID} AS id, strlen(text) AS len FROM documents WHERE lang = 'en' AND text IS NOT NULL AND strlen(text) > 3000")
def sql_content(spark, d):
    text = "SELECT id, cast(octet_length(body) AS bigint) AS len FROM records WHERE lang = 'en' AND octet_length(body) > 3000"
    return _fetched(spark, SqlQuery(open_snapshot(spark, _filled(spark, d, "documents")), text))


@query(f"SELECT count(*) + 1 AS n, CAST(-7 AS BIGINT) AS least FROM ({_LIVE})")
def sql_over_a_writer(spark, d):
    """What the writer has staged is flushed before its SQL runs."""
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.put("user/staged", [("event_id", -7)])
        return _fetched(spark, SqlQuery(s, "SELECT count(*) AS n, min(event_id) AS least FROM records"))


@query("SELECT kind, code FROM (VALUES ('syntax', 'INVALID_ARGUMENT'), ('write', 'INVALID_ARGUMENT'), ('parameter', 'INVALID_ARGUMENT'), ('value', 'INVALID_ARGUMENT'), ('memory', 'RESOURCE_EXHAUSTED')) t(kind, code)")
def sql_errors(spark, d):
    from .plans.sql import SqlBudget, SqlOptions

    snap = open_snapshot(spark, _filled(spark, d, "events"))
    cases = {"syntax": "SELEC", "write": "DROP VIEW records", "parameter": "SELECT $2", "value": "SELECT 1 / (event_id - event_id) AS x FROM records", "memory": "SELECT 1"}
    out = []
    for kind, text in cases.items():
        try:
            q = SqlQuery(snap, text, [1], SqlOptions(11 if kind == "memory" else 1 << 20), SqlBudget(10 if kind == "memory" else 1 << 30))
            list(q)
            out.append((kind, "OK"))
        except LoomError as e:
            out.append((kind, e.code))
    return spark.createDataFrame(out, "kind string, code string")


# content


@query(f"SELECT {_ID} AS id, sha256(text) AS body_sha256 FROM documents WHERE text IS NOT NULL")
def store_contents(spark, d):
    return open_snapshot(spark, _filled(spark, d, "documents")).contents().select("id", F.sha2("body", 256).alias("body_sha256"))


@query("SELECT printf('conv/%08d/%06d', conv_id, turn) AS id, CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pieces FROM conversations")
def store_content_metadata(spark, d):
    """Of bodies cut by message; the fold isn't read."""
    return open_snapshot(spark, _filled(spark, d, "conversations")).records().select("id", F.explode("contents").alias("c")).select("id", F.col("c.pieces").alias("pieces"))


@query("SELECT count(*) AS pieces, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT DISTINCT text, strlen(text) AS n FROM documents WHERE text <> '')")
def store_fold(spark, d):
    return open_snapshot(spark, _filled(spark, d, "documents")).fold().agg(F.count("*").alias("pieces"), F.sum("len").alias("bytes"))


@query("SELECT DISTINCT sha256(text) AS piece FROM documents WHERE text <> ''")
def piece_semi_join(spark, d):
    live = content.live_pieces(open_snapshot(spark, _filled(spark, d, "documents")).records())
    return live.select(F.lower(F.hex("piece")).alias("piece"))


# maintenance


def _thinned(spark: SparkSession, d: str) -> Store:
    """The documents without every third."""
    s = Store.open(spark, _copy(spark, d, "documents"))
    gone = _t(spark, d, "documents").where("doc_id % 3 = 0").select(F.format_string("doc/%012d", "doc_id").alias("id"), F.lit(True).alias("tomb"), F.lit(None).cast("binary").alias("body"))
    s.ingest(gone)
    return s


_BY_TEXT = "SELECT text, strlen(text) AS n, bool_or(doc_id % 3 <> 0) AS live FROM documents WHERE text <> '' GROUP BY text"


@query(f"SELECT id, max(event_id) AS event_id FROM ({_VERSIONS}) WHERE part IN (1, 2) GROUP BY id")
def compact_merge(spark, d):
    """Parts 1 and 2 become one: superseded versions go, tombstones stay."""
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.merge_range(1, 2)
        return _events_of(s.versions().where("part = 1"))


@query(f"SELECT id, event_id FROM ({_LIVE})")
def compact_total(spark, d):
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.compact()
        return _events_of(s.versions())


@query(f"""SELECT CAST(first AS INTEGER) AS first, CAST(length AS INTEGER) AS length FROM (
 SELECT a.part AS first, b.part - a.part + 1 AS length, (SELECT sum(n) FROM (SELECT part, count(*) AS n FROM ({_VERSIONS}) GROUP BY part) c WHERE c.part BETWEEN a.part AND b.part) AS total
 FROM (SELECT DISTINCT part FROM ({_VERSIONS})) a JOIN (SELECT DISTINCT part FROM ({_VERSIONS})) b ON b.part > a.part AND b.part - a.part < 3)
 WHERE total <= (SELECT count(*) * 3 // 5 FROM ({_VERSIONS})) ORDER BY length DESC, first LIMIT 1""")
def plan_compaction(spark, d):
    """The widest run of at most three parts with at most three fifths of all rows."""
    snap = open_snapshot(spark, _filled(spark, d, "events"))
    sizes = [(p.rows, p.bytes) for p in snap.commit.parts]
    return _one(spark, "first int, length int", *introspect.plan_compaction(sizes, 3, sum(r for r, _ in sizes) * 3 // 5, 1 << 62))


@query(f"SELECT {PARTS - 2} AS parts, (SELECT count(*) FROM ({_LIVE})) AS live")
def compact_bounded(spark, d):
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.compact_bounded(max_parts=3)
        return _one(spark, "parts int, live long", len(s.commit.parts), s.records().count())


@query(f"SELECT count(*) FILTER (live) AS pieces_after, count(*) AS pieces_before, CAST(sum(CASE WHEN NOT live THEN n ELSE 0 END) AS BIGINT) AS bytes_reclaimed FROM ({_BY_TEXT})")
def refold(spark, d):
    with _thinned(spark, d) as s:
        r = s.refold()
    return _one(spark, "pieces_after long, pieces_before long, bytes_reclaimed long", r["pieces_after"], r["pieces_before"], r["bytes_reclaimed"])


@query(f"SELECT count(*) FILTER (NOT live) AS pieces, CAST(coalesce(sum(CASE WHEN NOT live THEN n END), 0) AS BIGINT) AS bytes, 'ERASED' AS before FROM ({_BY_TEXT})")
def punch_unreferenced(spark, d):
    """A retained commit reads what was destroyed as erased, not as damaged."""
    with _thinned(spark, d) as s:
        old = open_snapshot(spark, s.root, s.commit.number - 1)
        only = _t(spark, d, "documents").where("text <> ''").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max((F.col("doc_id") % 3 != 0)).alias("live")).where("not live").agg(F.min("doc_id")).first()[0]
        r = s.punch_unreferenced()
        try:
            open_snapshot(spark, s.root, old.commit.number).read_content(f"doc/{only:012d}")
            before = "READ"
        except LoomError as e:
            before = "ERASED" if type(e).__name__ == "Erased" else e.code
    return _one(spark, "pieces long, bytes long, before string", r["pieces"], r["bytes"], before)


@query(f"SELECT CAST(coalesce(sum(CASE WHEN live THEN n END), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(CASE WHEN NOT live THEN n END), 0) AS BIGINT) AS dead_bytes, count(*) FILTER (live) AS live_pieces, count(*) FILTER (NOT live) AS dead_pieces FROM ({_BY_TEXT})")
def content_liveness(spark, d):
    with _thinned(spark, d) as s:
        x = s.content_liveness()
    return _one(spark, "live_bytes long, dead_bytes long, live_pieces long, dead_pieces long", x["live_bytes"], x["dead_bytes"], x["live_pieces"], x["dead_pieces"])


@query(f"SELECT id, event_id FROM ({_LIVE}) WHERE CAST(substr(id, 6) AS BIGINT) % 7 <> 0")
def erase_ids(spark, d):
    """From a table of ids, some of which aren't there."""
    with Store.open(spark, _copy(spark, d, "events")) as s:
        ids = _t(spark, d, "events").where("user_id % 7 = 0").select(F.format_string("user/%08d", "user_id").alias("id"))
        s.erase_ids(ids.union(spark.createDataFrame([("user/none",)], "id string")))
        return _events_of(s.versions())


@query(f"SELECT id, event_id FROM ({_LIVE}) WHERE event_type <> 'click'")
def erase_where(spark, d):
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.erase_where("event_type", "click")
        return _events_of(s.versions())


@query(f"SELECT min(n) AS least, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, max(n) AS most FROM (SELECT count(*) AS n FROM ({_VERSIONS}) GROUP BY part)")
def part_distribution(spark, d):
    x = open_snapshot(spark, _filled(spark, d, "events")).part_distribution()["rows"]
    return _one(spark, "least long, p50 long, p95 long, most long", x["min"], x["p50"], x["p95"], x["max"])


# checks, backups, recovery


@query("SELECT 1 AS parts, (SELECT count(DISTINCT text) FROM documents WHERE text <> '') AS pieces, (SELECT count(text) FROM documents) AS contents")
def verify(spark, d):
    r = open_snapshot(spark, _filled(spark, d, "documents")).verify()
    return _one(spark, "parts int, pieces long, contents long", r["parts"], r["pieces"], r["contents"])


@query("SELECT 'CORRUPTION' AS verdict, count(*) AS mismatches FROM (SELECT DISTINCT text FROM documents WHERE text <> '' AND strlen(text) % 5 = 0)")
def verify_hash(spark, d):
    """Stored pieces are overwritten; verification finds each."""
    root = _copy(spark, d, "documents")
    snap = open_snapshot(spark, root)
    at = snap.files.at(snap.commit.folds[0])
    damaged = scratch.fresh_dir(spark, "damaged")
    scratch.written(snap.fold().withColumn("bytes", F.when(F.col("len") % 5 == 0, F.concat(F.substring("bytes", 2, 1 << 30), F.lit(b"\x00"))).otherwise(F.col("bytes"))), "damaged", damaged, "zstd")
    snap.files.delete(snap.commit.folds[0])
    Files(spark, damaged).rename(at)
    try:
        snap.verify()
        verdict = "SOUND"
    except LoomError as e:
        verdict = e.code
    return snap.fold().agg(F.lit(verdict).alias("verdict"), F.count_if(content.digest(F.col("bytes")) != F.col("piece")).alias("mismatches"))


@query("SELECT kind, verdict FROM (VALUES ('part', 'CORRUPTION'), ('missing', 'CORRUPTION'), ('chain', 'CORRUPTION')) t(kind, verdict)")
def verify_chain(spark, d):
    """A part that was written anew, one that is gone, a commit that was changed."""
    out = []
    for kind in ("part", "missing", "chain"):
        root = _copy(spark, d, "events")
        snap = open_snapshot(spark, root)
        path = snap.commit.parts[1].path
        if kind == "part":
            with scratch.scope(spark):
                scratch.written(spark.read.schema(RT.RECORD).parquet(snap.files.at(path)).withColumn("seq", F.col("seq") + 1), "altered").write.mode("overwrite").parquet(snap.files.at(path))
        elif kind == "missing":
            snap.files.delete(path)
        else:
            name = snap.files.names("_commits/[0-9]*.json")[1]
            snap.files.write(name, snap.files.read(name).replace(b'"next_seq": ', b'"next_seq": 1'))
        try:
            store.verify_chain(root, spark)
            out.append((kind, "SOUND"))
        except LoomError as e:
            out.append((kind, e.code))
    return spark.createDataFrame(out, "kind string, verdict string")


@query(f"SELECT id, event_id FROM ({_LIVE})")
def backup_restore(spark, d):
    a, b = scratch.fresh_dir(spark, "backup"), scratch.fresh_dir(spark, "restored")
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.backup(a)
    store.restore(spark, a, b)
    return _events_of(open_snapshot(spark, b).records())


@query(f"SELECT {PARTS - 1} AS recovered, count(*) AS live FROM (SELECT user_id, max_by(event_type, event_id) AS t FROM ({_SLICED}) WHERE part < {PARTS - 1} GROUP BY 1) WHERE t <> 'error'")
def recover_commit(spark, d):
    """The newest commit file is torn; the one before it becomes live."""
    root = _copy(spark, d, "events")
    files = Files(spark, root)
    name = files.names("_commits/[0-9]*.json")[-1]
    files.write(name, files.read(name)[:50])
    n = store.recover_commit(root, 1, spark)
    return _one(spark, "recovered int, live long", n, open_snapshot(spark, root).records().count())


@query("SELECT true AS adds_up, true AS some_live, true AS some_kept")
def space_usage(spark, d):
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.compact()
        x = s.space_usage()
    return _one(spark, "adds_up boolean, some_live boolean, some_kept boolean", x["live"] + x["retained_only"] + x["unclassified"] == x["total"], x["live"] > 0, x["retained_only"] > 0)


@query("SELECT operation, attempts, succeeded FROM (VALUES ('apply', 2, 2), ('flush', 1, 1), ('compact', 1, 1)) t(operation, attempts, succeeded)")
def metrics(spark, d):
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.put("a", [("x", 1)])
        s.delete("a")
        s.flush()
        s.compact()
        m = s.metrics()["operations"]
    return spark.createDataFrame([(k, m[k]["attempts"], m[k]["succeeded"]) for k in ("apply", "flush", "compact")], "operation string, attempts int, succeeded int")


@query("SELECT sequence, operation FROM (VALUES (1, 'apply'), (2, 'flush'), (3, 'apply'), (4, 'sync')) t(sequence, operation)")
def lifecycle_events(spark, d):
    with Store.open(spark, _copy(spark, d, "events")) as s:
        s.put("a", [("x", 1)])
        s.flush()
        s.put("b", [("x", 1)])
        s.sync()
        return spark.createDataFrame([(e["sequence"], e["operation"]) for e in s.lifecycle_events_after(0)["events"]], "sequence int, operation string")


@query(f"SELECT (SELECT count(*) FROM ({_LIVE})) + 1 AS live, 2 AS replayed, 2 AS deduplicated")
def replay_after_a_crash(spark, d):
    """A writer that never closed had synced two puts of one body; they come back."""
    root = _copy(spark, d, "events")
    s = Store.open(spark, root)
    s.put_body("zz/1", b"[1, 1]")
    s.put_body("zz/2", b"[1, 1]")
    s.sync()
    s.files.delete("_lock")
    with Store.open(spark, root) as t:
        n = t.replay()
        t.delete("zz/2")
        t.flush()
        return _one(spark, "live long, replayed int, deduplicated int", t.records().count(), n, t.read_content("zz/1").count(b"1"))


# importers, streams


@query("SELECT printf('import:%09d', row_number() OVER (ORDER BY doc_id) - 1) AS id, sha256(text) AS body_sha256 FROM documents WHERE text IS NOT NULL")
def import_jsonl(spark, d):
    """Documents as files of JSON lines without ids, whose names follow doc_id; those
    without a text are skipped."""
    at = scratch.fresh_dir(spark, "lines")
    lines = _t(spark, d, "documents").orderBy(F.asc_nulls_last("doc_id")).select(F.to_json(F.struct(F.col("text").alias("body"), "lang", "n_chars")).alias("value"))
    lines.write.text(at)
    rows = importers.jsonl(spark, at).where("not skipped")
    return rows.select("id", F.sha2(F.encode("body", "UTF-8"), 256).alias("body_sha256"))


@query("""SELECT printf('span/%032d/%020d/%016d', user_id, epoch_us(ts) * 1000, event_id) AS id, event_type AS name, CAST(1000 * event_id AS BIGINT) AS duration, CAST(2 AS BIGINT) AS tags, sha256('[{"role":"user"}]') AS messages, CAST(2 AS INTEGER) AS contents FROM events""")
def import_spans(spark, d):
    """Spans as JSON text, into a store, and read again."""
    e = _t(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    span = F.struct(
        F.format_string("%032d", "user_id").alias("traceId"),
        F.format_string("%016d", "event_id").alias("spanId"),
        F.col("event_type").alias("name"),
        start.cast("string").alias("startTimeUnixNano"),
        (start + 1000 * F.col("event_id")).cast("string").alias("endTimeUnixNano"),
        F.struct(F.array(F.lit("a"), F.lit("b")).alias("tags"), F.array(F.struct(F.lit("user").alias("role"))).alias("gen_ai.input.messages")).alias("attributes"),
        F.array(F.struct(F.lit("choice").alias("name"))).alias("events"),
    )
    with Store.open(spark, scratch.fresh_dir(spark, "spans")) as s:
        s.ingest(importers.spans(e.select(F.to_json(span).alias("value"))))
        r = s.records()
        picked = r.select("id", predicates.first_occurrence("otel.name", 0)["s"].alias("name"), predicates.first_occurrence("otel.duration_ns", 1)["i"].alias("duration"), F.size(F.filter("attrs", lambda a: a["name"] == "tags")).cast("long").alias("tags"), F.size("contents").alias("contents"))
        return picked.join(s.contents("gen_ai.input.messages").select("id", F.sha2("body", 256).alias("messages")), "id")


@query("""SELECT printf('unknown/%013d/r%d#%s', event_id, user_id, kind) AS id, CASE kind WHEN 'input' THEN '[{"text":"' || event_type || '"}]' ELSE '{"out":' || event_id || '}' END AS body FROM events, (VALUES ('input'), ('output')) k(kind)""")
def import_calls(spark, d):
    e = _t(spark, d, "events")
    call = F.struct(F.col("event_id").alias("ts"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("responseId"), F.array(F.struct(F.col("event_type").alias("text"))).alias("inputMessages"), F.struct(F.col("event_id").alias("out")).alias("outputMessages"))
    return importers.calls(e.select(F.to_json(call).alias("value"))).select("id", F.decode("body", "UTF-8").alias("body"))


@query(f"SELECT id, event_id FROM ({_LIVE})")
def stream_ingest(spark, d):
    """A stream of versions, a part per micro-batch; started again, it adds nothing."""
    source, checkpoint = scratch.fresh_dir(spark, "stream-source"), scratch.fresh_dir(spark, "stream-checkpoint")
    e = _t(spark, d, "events").withColumn("tomb", F.col("event_type") == "error").withColumn("id", F.format_string("user/%08d", "user_id"))
    rows = importers.attributes(e, {"event_id": "int"}).select("id", "attrs", "tomb", F.lit(None).cast("binary").alias("body"), F.col("event_id").alias("ts"))
    rows.write.parquet(source)
    with Store.open(spark, scratch.fresh_dir(spark, "streamed")) as s:
        for _ in range(2):
            stream = spark.readStream.schema(rows.schema).parquet(source)
            into(s, stream, checkpoint, once=True).awaitTermination()
        return _events_of(s.records())
