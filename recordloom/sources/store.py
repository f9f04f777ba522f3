"""The store: parts of record versions, a fold of pieces, and a chain of commits.

    parts/<uid>/             Parquet, ids in ranges, sorted; at most one version of an id
    stats/<uid>/             Parquet, one row a file of the part: ids, digest, zones
    fold/gen=<g>/<uid>/      Parquet, one row a piece
    _commits/<n>.json        what is visible at commit n, and the digest of n - 1
    _lock                    held by the one writer

A commit file is written whole and renamed into place last; whatever no commit names
is not there. Batches stage in the writer and reach a part at ``flush``; tables of
any size go in through ``ingest`` without passing the driver. The driver holds lists
of parts and staged batches, never table data; files are digested and copied in
executors. The folder may be on any file system that Hadoop knows.

Reads take from a part only the files whose ids, or, in a store of one part, whose
attribute values (zones) can matter, and a page of a scan only as many ids as its
budgets can use (marks, every MARK-th id).
"""

from __future__ import annotations

import collections
import hashlib
import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from .. import types as RT
from ..control import Control
from ..errors import BudgetTooSmall, Cancelled, Contention, Corruption, Erased, InvalidArgument, IoFailure, NotFound, ResourceExhausted, classify
from ..operators import content, introspect, predicates, resolve
from ..operators import scan as scanning
from ..operators.content import Carve
from ..types import Record, Value
from .files import Files

FORMAT = 1
RETAINED = 4
AUTO_COMPACT = 8
#: Rows of a file between two marks.
MARK = 4096


@dataclass(frozen=True)
class WriteLimits:
    max_record_bytes: int = 64 << 20
    max_batch_bytes: int = 256 << 20
    max_batch_records: int = 4096
    max_identifier_bytes: int = 4 << 10


@dataclass
class Batch:
    """Ordered puts and deletes, applied all or not at all; the last of an id stands."""

    operations: list[tuple[str, str, list[tuple[str, Value]], dict[str, tuple[bytes, Any]]]] = field(default_factory=list)

    def put(self, id: str, attrs: list[tuple[str, Any]] | None = None, contents: dict[str, bytes] | None = None, carve: Carve = Carve()) -> Batch:
        self.operations.append(("put", id, [(n, Value.of(v)) for n, v in attrs or []], {n: (bytes(b), carve) for n, b in (contents or {}).items()}))
        return self

    def put_body(self, id: str, body: bytes, attrs: list[tuple[str, Any]] | None = None, carve: Carve = Carve()) -> Batch:
        return self.put(id, attrs, {"body": body}, carve)

    def put_spans(self, id: str, spans: dict[str, list[tuple[bool, bytes]]], attrs: list[tuple[str, Any]] | None = None) -> Batch:
        """Contents already cut: (foldable, bytes) in order."""
        self.operations.append(("put", id, [(n, Value.of(v)) for n, v in attrs or []], {n: (b"".join(b for _, b in s), s) for n, s in spans.items()}))
        return self

    def delete(self, id: str) -> Batch:
        self.operations.append(("delete", id, [], {}))
        return self

    def write(self, operation: dict[str, Any]) -> Batch:
        """An operation in the wire form."""
        import base64

        if operation.get("kind") == "delete":
            return self.delete(operation["id"])
        if operation.get("kind") != "put":
            raise InvalidArgument("an operation is a put or a delete")
        names = [c["name"] for c in operation.get("contents", [])]
        if len(set(names)) < len(names):
            raise InvalidArgument("a content name is given twice")
        contents = {c["name"]: base64.b64decode(c["base64"]) for c in operation.get("contents", [])}
        return self.put(operation["id"], [(a["name"], Value.decode(a["value"])) for a in operation.get("attrs", [])], contents)

    def __len__(self) -> int:
        return len(self.operations)


@dataclass(frozen=True)
class Part:
    path: str
    lo: int
    hi: int
    rows: int
    bytes: int
    digest: str
    stats: str
    files: int
    first_id: str
    last_id: str
    #: Distinct (name, tag) of the attributes, and names of the contents.
    attributes: tuple[tuple[str, int], ...]
    contents: tuple[str, ...]

    @staticmethod
    def decode(x: dict[str, Any]) -> Part:
        return Part(**{**x, "attributes": tuple((n, t) for n, t in x["attributes"]), "contents": tuple(x["contents"])})


@dataclass(frozen=True)
class Commit:
    number: int
    parts: tuple[Part, ...]
    fold_gen: int
    folds: tuple[str, ...]
    next_seq: int
    erased: tuple[str, ...] = ()
    previous: str = ""
    #: The last micro-batch taken from each stream.
    streams: tuple[tuple[str, int], ...] = ()
    hash: str = content.HASH
    format: int = FORMAT

    def encode(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()

    @staticmethod
    def decode(raw: bytes) -> Commit:
        x = json.loads(raw)
        if x["format"] != FORMAT:
            raise Corruption(f"format {x['format']} is not known")
        return Commit(**{**x, "parts": tuple(map(Part.decode, x["parts"])), "folds": tuple(x["folds"]), "erased": tuple(x["erased"]), "streams": tuple((n, k) for n, k in x["streams"])})


#: Tag of a content's name among a file's zones.
CONTENT = -1
STATS_COLUMNS = ["file", "rows", "bytes", "digest", "first_id", "last_id", "lo", "hi", "marks", "zones"]
STATS = "file string, rows long, bytes long, digest string, first_id string, last_id string, lo long, hi long, marks array<string>, zones array<struct<name:string,tag:int,least_n:decimal(20,0),greatest_n:decimal(20,0),least_f:double,greatest_f:double,poisoned:boolean>>"


def _joined_digest(rows: list[tuple[str, str]]) -> str:
    """Of a part, from its files' (name, digest)."""
    h = hashlib.sha256()
    for name, digest in sorted(rows):
        h.update(name.encode() + bytes.fromhex(digest))
    return h.hexdigest()


class Snapshot:
    """An immutable committed cut; any number may be open beside the writer."""

    def __init__(self, spark: SparkSession, root: Any, commit: Commit):
        self.spark, self.files, self.commit = spark, Files(spark, root), commit
        self.root = self.files.root

    # -- tables

    def versions(self, start: str | None = None, end: str | None = None, tests: tuple[predicates.Predicate, ...] = ()) -> DataFrame:
        """All committed versions, with column part; of ids in [start, end), if given.
        With one part, files whose zones exclude ``tests`` are left out as well; with
        several they aren't, as one of them might hide an older version."""
        out = None
        zoned = tests if len(self.commit.parts) == 1 else ()
        for i, p in enumerate(self.commit.parts):
            names = self._pruned(p, start, end, zoned)
            if names == []:
                continue
            places = [self.files.at(p.path)] if names is None else [self.files.at(f"{p.path}/{n}") for n in names]
            df = self.spark.read.schema(RT.RECORD).parquet(*places).withColumn("part", F.lit(i))
            out = df if out is None else out.unionByName(df)
        if out is None:
            return self.spark.createDataFrame([], RT.RECORD).withColumn("part", F.lit(0))
        return resolve.bounded(out, start, end)

    def _stats(self, p: Part) -> DataFrame:
        return self.spark.read.schema(STATS).parquet(self.files.at(p.stats))

    def _pruned(self, p: Part, start: str | None, end: str | None, tests: tuple[predicates.Predicate, ...]) -> list[str] | None:
        """The part's files that can matter; None for all of them."""
        if not p.rows or (start is not None and p.last_id.encode() < start.encode()) or (end is not None and p.first_id.encode() >= end.encode()):
            return []
        zones = [z for z in map(predicates.zone, tests) if z is not None]
        inside = (start is None or start.encode() <= p.first_id.encode()) and (end is None or p.last_id.encode() < end.encode())
        if not zones and (inside or p.files == 1):
            return None
        stats = self._stats(p)
        if start is not None:
            stats = stats.where(F.col("last_id") >= start)
        if end is not None:
            stats = stats.where(F.col("first_id") < end)
        for z in zones:
            stats = stats.where(z)
        return [r["file"] for r in stats.select("file").collect()]

    def mark(self, start: str | None, end: str | None, reverse: bool, rows: int) -> str | None:
        """An id by which about ``rows`` versions of [start, end) lie before it in the
        direction of a scan; None if there aren't so many."""
        most = -(-rows // MARK) + len(self.commit.parts)
        found = None
        for p in self.commit.parts:
            own = resolve.bounded(self._stats(p).select(F.explode("marks").alias("id")), start, end)
            found = own if found is None else found.unionByName(own)
        if found is None or sum(p.rows for p in self.commit.parts) <= rows:
            return None
        ids = [r["id"] for r in found.orderBy(F.desc("id") if reverse else F.asc("id")).limit(most + 1).collect()]
        return ids[-1] if len(ids) > most else None

    def records(self) -> DataFrame:
        """Live records. With one part ids are unique already, and no window is needed."""
        if len(self.commit.parts) == 1:
            return self.versions().where("not tomb")
        return resolve.live(self.versions())

    def fold(self) -> DataFrame:
        paths = [self.files.at(f) for f in self.commit.folds]
        if not paths:
            return self.spark.createDataFrame([], RT.FOLD)
        fold = self.spark.read.schema(RT.FOLD).parquet(*paths)
        erased = self.erased()
        return fold if erased is None else fold.join(erased, "piece", "left_anti")

    def erased(self) -> DataFrame | None:
        """Pieces destroyed on purpose, by this commit or a later one."""
        live = _commits(self.files)
        names = set(self.commit.erased) | set(live[max(live)].erased if live else ())
        paths = [self.files.at(n) for n in sorted(names) if self.files.exists(n)]
        return self.spark.read.schema("piece binary").parquet(*paths) if paths else None

    # -- reads

    def get(self, id: str) -> Record | None:
        rows = resolve.live(self._of(id)).collect()
        if not rows:
            return None
        r = rows[0]
        contents = {c["name"]: {"len": c["len"], "pieces": c["pieces"], "identity": bytes(c["identity"]).hex()} for c in r["contents"] or []}
        return Record(id, [(a["name"], Value.from_row(a)) for a in r["attrs"] or []], contents)

    def _of(self, id: str) -> DataFrame:
        """Versions of one id, from the files that may have it."""
        return self._view(id, id + "\0").where(F.col("id") == id)

    def exists(self, id: str) -> bool:
        return not resolve.live(self._of(id)).isEmpty()

    def read_content(self, id: str, name: str = "body") -> bytes | None:
        programs = resolve.live(self._of(id)).select("id", F.explode("contents").alias("c")).where(F.col("c.name") == name)
        programs = programs.select("id", F.col("c.identity").alias("identity"), F.col("c.ops").alias("ops"))
        erased = self.erased()
        if erased is not None:
            used = programs.select(F.explode("ops").alias("o")).select(F.col("o.piece").alias("piece"))
            if not used.join(erased, "piece", "left_semi").isEmpty():
                raise Erased(f"content {name!r} of {id!r} was erased")
        with _typed():
            rows = content.reconstruct(programs, self._fold(), ["id"]).collect()
        return bytes(rows[0]["body"]) if rows else None

    def contents(self, name: str = "body") -> DataFrame:
        """(id, body) of one named content of all live records."""
        programs = self.records().select("id", F.explode("contents").alias("c")).where(F.col("c.name") == name)
        return content.reconstruct(programs.select("id", F.col("c.identity").alias("identity"), F.col("c.ops").alias("ops")), self._fold(), ["id"])

    def ids(self) -> DataFrame:
        return self.records().select("id").orderBy("id")

    def scan_ids(self, start: str | None = None, end: str | None = None, limit: int = 100, reverse: bool = False) -> list[str]:
        if start is not None and end is not None and start.encode() > end.encode():
            raise InvalidArgument("the id range is inverted")
        first = start
        last = end
        if (bound := self.mark(start, end, reverse, 4 * limit)) is not None:
            # enough in all likelihood; else the rest is read too
            first, last = (bound, end) if reverse else (start, bound)
            ids = self._first_ids(first, last, limit, reverse)
            if len(ids) == limit:
                return ids
        return self._first_ids(start, end, limit, reverse)

    def _first_ids(self, start: str | None, end: str | None, limit: int, reverse: bool) -> list[str]:
        live = resolve.live(self._view(start, end)).select("id")
        return [r["id"] for r in live.orderBy(F.desc("id") if reverse else F.asc("id")).limit(limit).collect()]

    def scan(self, request: scanning.ScanRequest) -> scanning.ScanPage:
        with _typed():
            return scanning.scan(self, self._fold(), request, self.erased())

    def explain_scan(self, request: scanning.ScanRequest) -> scanning.ScanExplanation:
        return scanning.explain(self, request, len(self.commit.parts))

    def schema(self) -> introspect.Schema:
        """From what the commit says of its parts; no table is read."""
        pairs = {x for p in self.commit.parts for x in p.attributes}
        names = {c for p in self.commit.parts for c in p.contents}
        return introspect.schema_of(pairs, names, superset=len(self.commit.parts) > 0)

    def lens(self) -> DataFrame:
        from ..plans import lens

        return lens.flat(self.records(), self.schema(), self.contents)

    def _view(self, start: str | None = None, end: str | None = None, tests: tuple[predicates.Predicate, ...] = ()) -> DataFrame:
        return self.versions(start, end, tests)

    def _fold(self) -> DataFrame:
        return self.fold()

    # -- checks and figures

    def verify(self, control: Control | None = None) -> dict[str, int]:
        """The commit chain, every part's digest, every piece's hash, and every live
        content put together; raises Corruption at the first mismatch."""
        control = control or Control()
        control.check("verify")
        chain = verify_chain(self.root, self.spark)
        bad = self.fold().where(content.digest(F.col("bytes")) != F.col("piece")).count()
        if bad:
            raise Corruption(f"{bad} pieces differ from their hash")
        control.check("verify")
        names = [r["n"] for r in self.records().select(F.explode("contents").alias("c")).select(F.col("c.name").alias("n")).distinct().collect()]
        total = 0
        with _typed():
            for n in names:
                total += self.contents(n).agg(F.count("body")).first()[0]
        control.check("verify")
        return {"commits": chain["commits"], "parts": chain["parts"], "pieces": self.fold().count(), "contents": total}

    def part_distribution(self) -> dict[str, dict[str, int]]:
        return introspect.distribution([p.rows for p in self.commit.parts], [p.bytes for p in self.commit.parts])

    def content_liveness(self) -> dict[str, int]:
        return introspect.liveness(self.records(), self.fold())

    def estimate_refold_space(self) -> dict[str, int]:
        x = self.content_liveness()
        return {"live_bytes": x["live_bytes"], "reclaimable_bytes": x["dead_bytes"], "peak_extra_bytes": x["live_bytes"] + sum(p.bytes for p in self.commit.parts)}


@contextmanager
def _typed():
    """Spark's raise_error in our terms."""
    try:
        yield
    except Exception as e:
        if isinstance(e, Cancelled | Corruption | InvalidArgument):
            raise
        if "ERASED:" in str(e):
            raise Erased("a piece was erased") from e
        if "CORRUPTION:" in str(e):
            raise Corruption("stored content differs from its hash") from e
        raise


def _commits(files: Files) -> dict[int, Commit]:
    out = {}
    for name in files.names("_commits/[0-9]*.json"):
        try:
            c = Commit.decode(files.read(name))
        except (ValueError, KeyError, TypeError):
            continue  # an unreadable retained commit pins nothing
        out[_number(name)] = c
    return out


def _number(name: str) -> int:
    return int(name.rpartition("/")[2].partition(".")[0])


def _files(root: Any, spark: SparkSession | None) -> Files:
    return Files(spark or SparkSession.builder.getOrCreate(), root)


def read_commits(root: Any, spark: SparkSession | None = None) -> dict[int, Commit]:
    return _commits(_files(root, spark))


def verify_chain(root: Any, spark: SparkSession | None = None) -> dict[str, int]:
    """Every commit follows from the one before, and every part is what it was."""
    files = _files(root, spark)
    names = files.names("_commits/[0-9]*.json")
    previous, seen = None, {}
    for name in names:
        raw = files.read(name)
        try:
            c = Commit.decode(raw)
        except (ValueError, KeyError, TypeError) as e:
            raise Corruption(f"commit {_number(name)} can't be read") from e
        if previous is not None and c.previous != previous:
            raise Corruption(f"commit {c.number} doesn't follow the one before it")
        previous = hashlib.sha256(raw).hexdigest()
        for p in c.parts:
            # parts that only retained commits name may have been erased since
            if p.path not in seen and (files.exists(p.path) or name == names[-1]):
                seen[p.path] = p
    listed = {p: files.names(f"{p}/*.parquet") for p in seen}
    found: dict[str, list[tuple[str, str]]] = {p: [] for p in seen}
    every = [n for ns in listed.values() for n in ns]
    for r in files.digests(every).collect() if every else []:  # a line a file
        path, _, name = r["name"].rpartition("/")
        found[path].append((name, r["digest"]))
    for path, p in seen.items():
        if not listed[path] and p.files:
            raise Corruption(f"part {path} is missing")
        if _joined_digest(found[path]) != p.digest:
            raise Corruption(f"part {path} differs from its digest")
    return {"commits": len(names), "parts": len(seen)}


def open_snapshot(spark: SparkSession, root: Any, commit: int | None = None) -> Snapshot:
    """A committed cut: the newest, or a retained one."""
    commits = read_commits(root, spark)
    if not commits:
        raise NotFound(f"no store at {root}")
    number = max(commits) if commit is None else commit
    if number not in commits:
        raise NotFound(f"commit {number} is not retained")
    return Snapshot(spark, root, commits[number])


def retained_commits(root: Any, spark: SparkSession | None = None) -> list[int]:
    return sorted(read_commits(root, spark))


def recover_commit(root: Any, max_rollback: int = 0, spark: SparkSession | None = None) -> int:
    """Drops unreadable newest commit files, at most ``max_rollback`` of them, so that
    the newest readable one is live. Returns its number."""
    files = _files(root, spark)
    good = _commits(files)
    bad = [n for n in files.names("_commits/[0-9]*.json") if _number(n) not in good and (not good or _number(n) > max(good))]
    if not good:
        raise Corruption("no commit can be read")
    if len(bad) > max_rollback:
        raise ResourceExhausted(f"{len(bad)} commits would be rolled back", "max_rollback", len(bad), max_rollback)
    for n in bad:
        files.delete(n)
    return max(good)


class Store(Snapshot):
    """The writer. Reads see staged operations too; SQL and lens see commits."""

    def __init__(self, spark: SparkSession, root: Any, limits: WriteLimits = WriteLimits()):
        files = Files(spark, root)
        files.mkdirs("_commits")
        if not files.create("_lock", uuid.uuid4().hex.encode()):
            raise Contention("another writer has the store")
        self.limits = limits
        self.events: collections.deque = collections.deque(maxlen=256)
        self._event = 0
        self.counters: dict[str, dict[str, int]] = {}
        self.dedup = {"pieces": 0, "dedup_hits": 0, "logical_bytes": 0, "novel_bytes": 0}
        self._staged: dict[str, tuple[int, Any]] = {}
        self._staged_bytes = 0
        self._closed = False
        commits = _commits(files)
        live = commits[max(commits)] if commits else Commit(0, (), 0, (), 0)
        super().__init__(spark, root, live)
        self._next_seq = live.next_seq
        if not commits:
            self._publish(live)

    @classmethod
    def open(cls, spark: SparkSession, root: Any, limits: WriteLimits = WriteLimits()) -> Store:
        return cls(spark, root, limits)

    def close(self) -> None:
        if not self._closed:
            self.sync()
            self._closed = True
            self.files.delete("_lock")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    @contextmanager
    def _operation(self, name: str, control: Control | None = None):
        c = self.counters.setdefault(name, {"attempts": 0, "succeeded": 0, "failed": 0, "cancelled": 0, "duration_ns": 0})
        c["attempts"] += 1
        began = time.monotonic_ns()
        outcome = "failed"
        try:
            (control or Control()).check(name)
            yield
            outcome = "succeeded"
        except Cancelled:
            outcome = "cancelled"
            raise
        finally:
            c[outcome] += 1
            c["duration_ns"] += time.monotonic_ns() - began
            self._event += 1
            self.events.append({"sequence": self._event, "operation": name, "outcome": outcome, "commit": self.commit.number})

    # -- writing

    def apply(self, batch: Batch) -> None:
        """Stages a batch after checking all of it."""
        with self._operation("apply"):
            self._admit(batch)
            for kind, id, attrs, contents in batch.operations:
                seq = self._next_seq
                self._next_seq += 1
                old = self._staged.get(id)
                self._staged_bytes -= _size(*old[1]) if old and old[1] else 0
                self._staged[id] = (seq, (id, attrs, contents) if kind == "put" else None)
                self._staged_bytes += _size(id, attrs, contents)

    def put(self, id: str, attrs: list[tuple[str, Any]] | None = None, contents: dict[str, bytes] | None = None, carve: Carve = Carve()) -> None:
        self.apply(Batch().put(id, attrs, contents, carve))

    def put_body(self, id: str, body: bytes, attrs: list[tuple[str, Any]] | None = None, carve: Carve = Carve()) -> None:
        self.apply(Batch().put_body(id, body, attrs, carve))

    def delete(self, id: str) -> None:
        self.apply(Batch().delete(id))

    def write(self, operations: list[dict[str, Any]]) -> None:
        batch = Batch()
        for o in operations:
            batch.write(o)
        self.apply(batch)

    def _admit(self, batch: Batch) -> None:
        lim = self.limits
        if len(batch) > lim.max_batch_records:
            raise ResourceExhausted("too many records in a batch", "max_batch_records", len(batch), lim.max_batch_records)
        total = 0
        for _, id, attrs, contents in batch.operations:
            for name in (id, *(n for n, _ in attrs), *contents):
                if not name and (name is id or name in contents):
                    raise InvalidArgument("an identifier is empty")
                if len(name.encode()) > lim.max_identifier_bytes:
                    raise ResourceExhausted("an identifier is too long", "max_identifier_bytes", len(name.encode()), lim.max_identifier_bytes)
            size = _size(id, attrs, contents)
            if size > lim.max_record_bytes:
                raise ResourceExhausted("a record is too large", "max_record_bytes", size, lim.max_record_bytes)
            total += size
        if total > lim.max_batch_bytes:
            raise ResourceExhausted("a batch is too large", "max_batch_bytes", total, lim.max_batch_bytes)

    def _staged_frames(self) -> tuple[DataFrame, DataFrame]:
        """Staged versions as (records, pieces)."""
        records, found = [], {}
        for id, (seq, what) in self._staged.items():
            if what is None:
                records.append((id, seq, True, [], []))
                continue
            _, attrs, contents = what
            built = []
            for name in sorted(contents, key=str.encode):
                body, how = contents[name]
                if isinstance(how, Carve):
                    spans = [(f, body[s : s + n]) for f, s, n in how.spans(body)]
                else:
                    spans = how
                program, n = [], 0
                for foldable, data in spans:
                    if foldable:
                        h = hashlib.sha256(data).digest()
                        found.setdefault(h, (h, len(data), data, seq))
                        program.append((1, None, h, len(data)))
                        n += 1
                    else:
                        program.append((0, data, None, len(data)))
                built.append((name, len(body), n, hashlib.sha256(body).digest(), program))
            records.append((id, seq, False, [v.row(n) for n, v in attrs], built))
        return self.spark.createDataFrame(records, RT.RECORD), self.spark.createDataFrame(list(found.values()), RT.FOLD)

    def _view(self, start: str | None = None, end: str | None = None, tests: tuple[predicates.Predicate, ...] = ()) -> DataFrame:
        if not self._staged:
            return self.versions(start, end, tests)
        # a staged version hides committed ones, whose zones then say nothing
        return self.versions(start, end).unionByName(resolve.bounded(self._staged_frames()[0].withColumn("part", F.lit(-1)), start, end))

    def _fold(self) -> DataFrame:
        return self.fold() if not self._staged else self.fold().unionByName(self._staged_frames()[1])

    def sync(self, control: Control | None = None) -> None:
        """Makes staged operations durable: a journal beside the commits."""
        with self._operation("sync", control):
            if not self._staged:
                self.files.delete("_staged.json")
                return
            rows = [[id, seq, None if what is None else [[n, v.encode()] for n, v in what[1]], {} if what is None else {n: _spans(b, how) for n, (b, how) in what[2].items()}] for id, (seq, what) in self._staged.items()]
            self.files.write("_staged.json", json.dumps({"after": self.commit.number, "rows": rows}).encode())

    def replay(self) -> int:
        """Stages again what a writer that never closed had made durable."""
        import base64

        if not self.files.exists("_staged.json"):
            return 0
        rows = json.loads(self.files.read("_staged.json"))["rows"]
        for id, seq, attrs, contents in rows:
            if seq < self.commit.next_seq:
                continue
            spans = {n: [(f, base64.b64decode(x)) for f, x in s] for n, s in contents.items()}
            what = None if attrs is None else (id, [(n, Value.decode(v)) for n, v in attrs], {n: (b"".join(x for _, x in s), s) for n, s in spans.items()})
            self._staged[id] = (seq, what)
            self._next_seq = max(self._next_seq, seq + 1)
        return len(rows)

    def flush(self, control: Control | None = None) -> Part | None:
        """Staged versions become a part; their new pieces enter the fold first."""
        with self._operation("flush", control):
            if not self._staged:
                return None
            records, found = self._staged_frames()
            metrics = content.dedup_metrics(found).first()
            fresh = content.novel(found.withColumnRenamed("first_seq", "seq"), self.fold() if self.commit.folds else None)
            part = self._append(records.coalesce(1), fresh, (metrics["pieces"], metrics["logical_bytes"]), control, ranged=False)  # a batch is small
            self._staged, self._staged_bytes = {}, 0
            self.files.delete("_staged.json")
            return part

    def ingest(self, bodies: DataFrame, carve: Carve = Carve(), control: Control | None = None, mark: tuple[str, int] | None = None) -> Part | None:
        """A table of any size as one part: id, optional attrs (array of attribute
        structs), body (binary or string; null: no content) or contents (a map of names
        to binary), optional tomb. Ids are
        unique; sequence numbers follow id order within the part's range. ``mark`` (a
        stream and the number of its batch) is published in the same commit."""
        with self._operation("ingest", control), scratch.scope(self.spark):
            self.flush()
            lim = self.limits
            attrs = F.col("attrs") if "attrs" in bodies.columns else RT.no_attrs()
            tomb = F.coalesce("tomb", F.lit(False)) if "tomb" in bodies.columns else F.lit(False)
            pair = lambda name, body: F.struct(name.alias("name"), body.cast("binary").alias("body"))
            if "contents" in bodies.columns:
                pairs = F.transform(F.map_entries("contents"), lambda e: pair(e["key"], e["value"]))
            else:
                pairs = F.when(F.col("body").isNotNull(), F.array(pair(F.lit("body"), F.col("body"))))
            pairs = F.coalesce(pairs, F.array().cast("array<struct<name:string,body:binary>>"))
            # the table is asked for once; all that follows reads what was cut and hashed
            cut = bodies.select("id", attrs.alias("attrs"), tomb.alias("tomb"), content.held(pairs, carve).alias("held"), F.monotonically_increasing_id().alias("at"))
            cut = cut.withColumn("contents", F.transform("held", lambda h: content.contents_of(h["name"], h["body"], h["spans"])))
            at = scratch.fresh_dir(self.spark, "carved")
            cut = scratch.written(cut, "carved", at, "zstd")
            # what _size says of a staged record
            value = lambda a: F.coalesce(F.octet_length(a["s"]), F.octet_length(a["bin"]), F.lit(8))
            size = F.aggregate("attrs", (F.octet_length("id") + 64).cast("long"), lambda t, a: t + F.octet_length(a["name"]) + 16 + value(a))
            size = F.aggregate("contents.name", size, lambda t, n: t + F.octet_length(n) + 64)
            size = F.aggregate("contents.len", size, lambda t, n: t + n)
            lengths = (F.transform("attrs", lambda a: F.octet_length(a["name"])), F.transform("contents.name", F.octet_length))
            longest = F.greatest(F.octet_length("id"), *(F.coalesce(F.array_max(x), F.lit(0)) for x in lengths))
            folded = F.aggregate(F.flatten("held.spans"), F.lit(0).cast("long"), lambda t, s: t + F.when(s["foldable"], s["len"]).otherwise(0))
            pieces = F.aggregate("contents.pieces", F.lit(0).cast("long"), lambda t, n: t + n)
            n, distinct, empty, name, record, *counted = cut.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.coalesce(F.col("id"), F.lit("")) == ""), F.max(longest), F.max(size), F.sum(pieces), F.sum(folded)).first()
            if empty:
                raise InvalidArgument("an identifier is empty")
            if distinct < n:
                raise InvalidArgument("ids must be unique in one ingest")
            if not n:
                return None
            if name > lim.max_identifier_bytes:
                raise ResourceExhausted("an identifier is too long", "max_identifier_bytes", name, lim.max_identifier_bytes)
            if record > lim.max_record_bytes:
                raise ResourceExhausted("a record is too large", "max_record_bytes", record, lim.max_record_bytes)
            # one version an id, so a part's rows may share the sequence number
            seq, self._next_seq = self._next_seq, self._next_seq + 1
            records = cut.select("id", F.lit(seq).cast("long").alias("seq"), "tomb", "attrs", "contents")
            wanted = content.placed(cut)
            if self.commit.folds:
                wanted = wanted.join(self.fold().select("piece"), "piece", "left_anti")
            fresh = content.fetched(wanted, at, Files(self.spark, at).names("part-*"), seq)
            return self._append(records, fresh, counted, control, mark)

    def _append(self, records: DataFrame, fresh: DataFrame, counted: tuple[int, int], control: Control | None, mark: tuple[str, int] | None = None, ranged: bool = True) -> Part:
        """``fresh``: the pieces that the fold hasn't; ``counted``: how many pieces the
        records have, and bytes."""
        control = control or Control()
        fold, novel = self._write_fold(fresh, self.commit.fold_gen)
        part = self._write_part(records, ranged)
        self.dedup["pieces"] += counted[0]
        self.dedup["dedup_hits"] += counted[0] - novel[0]
        self.dedup["logical_bytes"] += counted[1]
        self.dedup["novel_bytes"] += novel[1]
        control.check("flush")  # the last moment before it is visible
        folds = (*self.commit.folds, fold) if novel[0] else self.commit.folds
        streams = tuple(sorted({**dict(self.commit.streams), mark[0]: mark[1]}.items())) if mark else self.commit.streams
        self._publish(replace(self.commit, number=self.commit.number + 1, parts=(*self.commit.parts, part), folds=folds, next_seq=self._next_seq, streams=streams))
        return part

    def _write_fold(self, pieces: DataFrame, gen: int) -> tuple[str, tuple[int, int]]:
        """Pieces as a table, with a Bloom filter on their hashes: its name, and how
        many pieces and bytes it has."""
        at = f"fold/gen={gen}/{uuid.uuid4().hex}"
        rows = pieces.select([f.name for f in RT.FOLD.fields])
        rows.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#piece", "true").parquet(self.files.at(at))
        n, size = self.spark.read.schema(RT.FOLD).parquet(self.files.at(at)).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return at, (n, size)

    def _write_part(self, records: DataFrame, ranged: bool = True) -> Part:
        """Ids in ranges, a file each, as many as the size asks for, with statistics."""
        uid = uuid.uuid4().hex
        at, stats = f"parts/{uid}", f"stats/{uid}"
        place = self.files.at(at)
        rows = records.select([f.name for f in RT.RECORD.fields])
        (rows.repartitionByRange("id") if ranged else rows).sortWithinPartitions("id").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#id", "true").parquet(place)
        rows = self.spark.read.schema(RT.RECORD).parquet(place).withColumns({"file": F.col("_metadata.file_name"), "k": F.col("_metadata.row_index")})
        per = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sort_array(F.collect_list(F.when(F.col("k") % MARK == 0, F.col("id")))).alias("marks"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        named = F.transform("contents", lambda c: F.struct(c["name"].alias("name"), F.lit(CONTENT).alias("tag"), F.lit(None).cast("decimal(20,0)").alias("n"), F.lit(None).cast("double").alias("f")))
        entries = rows.select("file", F.explode(F.concat(introspect.zone_entries(), named)).alias("z"))
        zones = introspect.zones_by(entries, "file").groupBy("file").agg(F.collect_list(F.struct("name", "tag", "least_n", "greatest_n", "least_f", "greatest_f", "poisoned")).alias("zones"))
        digests = self.files.digests(self.files.names(f"{at}/*.parquet")).select(F.element_at(F.split("name", "/"), -1).alias("file"), "bytes", "digest")
        every = per.join(zones, "file", "left").join(digests, "file").withColumn("zones", F.coalesce("zones", F.array().cast(STATS.rpartition(" ")[2])))
        every.select(STATS_COLUMNS).coalesce(1).write.parquet(self.files.at(stats))
        held = self.spark.read.schema(STATS).parquet(self.files.at(stats))
        # a line a file
        total = held.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.min("first_id"), F.max("last_id"), F.coalesce(F.min("lo"), F.lit(0)), F.coalesce(F.max("hi"), F.lit(0)), F.count("*"), F.collect_list(F.struct("file", "digest"))).first()
        pairs = [(r["name"], r["tag"]) for r in held.select(F.explode("zones").alias("z")).select("z.name", "z.tag").distinct().collect()]
        attributes = tuple(sorted(p for p in pairs if p[1] != CONTENT))
        contents = tuple(sorted(n for n, t in pairs if t == CONTENT))
        return Part(at, total[4], total[5], total[0], total[1], _joined_digest([tuple(x) for x in total[7]]), stats, total[6], total[2] or "", total[3] or "", attributes, contents)

    def _publish(self, commit: Commit) -> None:
        name = f"_commits/{commit.number:08d}.json"
        old = f"_commits/{self.commit.number:08d}.json"
        previous = hashlib.sha256(self.files.read(old)).hexdigest() if commit.number != self.commit.number and self.files.exists(old) else ""
        commit = replace(commit, previous=previous)
        self.files.write(name, commit.encode())
        self.commit = commit
        for gone in self.files.names("_commits/[0-9]*.json")[:-RETAINED]:
            self.files.delete(gone)
        self.vacuum()

    def vacuum(self) -> list[str]:
        """Deletes directories that no retained commit names."""
        commits = _commits(self.files).values()
        named = {x for c in commits for p in c.parts for x in (p.path, p.stats)} | {f for c in commits for f in c.folds} | {e for c in commits for e in c.erased}
        gone = []
        for pattern in ("parts/*", "stats/*", "fold/gen=*/*", "erased/*"):
            for name in self.files.names(pattern):
                if name not in named:
                    self.files.delete(name)
                    gone.append(name)
        return gone

    def snapshot(self, control: Control | None = None) -> Snapshot:
        self.sync(control)
        self.flush(control)
        return Snapshot(self.spark, self.root, self.commit)

    # -- maintenance

    def merge_range(self, lo: int, length: int, control: Control | None = None) -> dict[str, int] | None:
        """A run of parts becomes one: superseded versions go, tombstones only when
        the run is everything. No piece is touched."""
        with self._operation("compact", control):
            run = self.commit.parts[lo : lo + length]
            if len(run) < 2 or lo < 0:
                return None
            total = len(run) == len(self.commit.parts)
            keep = self.versions().where(F.col("part").between(lo, lo + length - 1))
            stats = resolve.statistics(keep).first()
            merged = resolve.newest(keep)
            part = self._write_part((merged.where("not tomb") if total else merged).drop("part"))
            part = replace(part, lo=min(p.lo for p in run), hi=max(p.hi for p in run))
            (control or Control()).check("compact")
            self._publish(replace(self.commit, number=self.commit.number + 1, parts=(*self.commit.parts[:lo], part, *self.commit.parts[lo + length :])))
            return {"parts": len(run), "rows_in": stats["physical_rows"], "rows_out": part.rows, "superseded": stats["superseded_rows"], "tombstones_dropped": stats["tombstones"] if total else 0}

    def compact(self, control: Control | None = None) -> dict[str, int] | None:
        return self.merge_range(0, len(self.commit.parts), control)

    def auto_compact(self) -> dict[str, int] | None:
        return self.compact() if len(self.commit.parts) >= AUTO_COMPACT else None

    def maybe_compact(self, trigger: int, run: int) -> dict[str, int] | None:
        return self.merge_range(0, min(run, len(self.commit.parts))) if len(self.commit.parts) >= trigger else None

    def plan_compaction(self, max_parts: int = 8, max_rows: int = 1 << 62, max_bytes: int = 1 << 62) -> tuple[int, int] | None:
        return introspect.plan_compaction([(p.rows, p.bytes) for p in self.commit.parts], max_parts, max_rows, max_bytes)

    def estimate_compaction_space(self, **budget: int) -> int | None:
        plan = self.plan_compaction(**budget)
        if plan is None:
            return None
        run = self.commit.parts[plan[0] : plan[0] + plan[1]]
        return sum(p.bytes + 64 * p.rows for p in run) + 256 * len(RT.RECORD.fields) * len(run) + (1 << 20)

    def compact_bounded(self, control: Control | None = None, **budget: int) -> dict[str, int] | None:
        plan = self.plan_compaction(**budget)
        return None if plan is None else self.merge_range(*plan, control)

    def _settled(self, what: str) -> None:
        if self._staged:
            raise InvalidArgument(f"{what} needs a flushed writer")

    def refold(self, control: Control | None = None) -> dict[str, int]:
        """A new generation of the fold with only what live records use, parts merged,
        and all history and snapshots dropped."""
        self._settled("refold")
        with self._operation("refold", control):
            before = self.fold().agg(F.coalesce(F.sum("len"), F.lit(0)), F.count("*")).first()
            live = self.records()
            gen = self.commit.fold_gen + 1
            kept = self.fold().join(content.live_pieces(live), "piece", "left_semi")
            at, (n, size) = self._write_fold(kept.sortWithinPartitions("first_seq"), gen)
            part = self._write_part(live.drop("part"))
            (control or Control()).check("refold")
            self._publish(replace(self.commit, number=self.commit.number + 1, parts=(part,) if part.rows else (), fold_gen=gen, folds=(at,) if n else (), erased=()))
            for name in self.files.names("_commits/[0-9]*.json")[:-1]:
                self.files.delete(name)
            self.vacuum()
            return {"pieces_before": before[1], "pieces_after": n, "bytes_reclaimed": before[0] - size}

    def punch_unreferenced(self, control: Control | None = None) -> dict[str, int]:
        """Destroys pieces no live record uses, in place of a refold: declared erased
        first, so a retained commit reads them as erased, never as damaged."""
        self._settled("punch")
        with self._operation("punch", control):
            fold = self.fold()
            dead = fold.join(content.live_pieces(self.records()), "piece", "left_anti")
            at = f"erased/{uuid.uuid4().hex}"
            dead.select("piece").write.parquet(self.files.at(at))
            n, size = dead.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            if not n:
                return {"pieces": 0, "bytes": 0}
            kept, _ = self._write_fold(fold.join(self.spark.read.schema("piece binary").parquet(self.files.at(at)), "piece", "left_anti"), self.commit.fold_gen)
            old = self.commit.folds
            (control or Control()).check("punch")
            self._publish(replace(self.commit, number=self.commit.number + 1, folds=(kept,), erased=(*self.commit.erased, at)))
            for name in self.files.names("_commits/[0-9]*.json")[:-1]:  # older commits now read the punched fold
                c = Commit.decode(self.files.read(name))
                if set(c.folds) & set(old):
                    self.files.write(name, replace(c, folds=(kept,)).encode())
            self._rechain()
            self.vacuum()
            return {"pieces": n, "bytes": size}

    def _rechain(self) -> None:
        previous = None
        for name in self.files.names("_commits/[0-9]*.json"):
            c = Commit.decode(self.files.read(name))
            if previous is not None and c.previous != previous:
                c = replace(c, previous=previous)
                self.files.write(name, c.encode())
            previous = hashlib.sha256(self.files.read(name)).hexdigest()
            if c.number == self.commit.number:
                self.commit = c

    def erase_ids(self, ids: list[str] | DataFrame, control: Control | None = None) -> dict[str, int]:
        """Deletes records and destroys what only they used; ``ids`` is a list or a
        table (id) of any size. A repeated id counts as absent after its first; with
        nothing to do the store stays untouched. Once it has begun it runs to its end."""
        with self._operation("erase", control), scratch.scope(self.spark):
            wanted = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
            requested = wanted.count()
            present = scratch.written(resolve.live(self._view()).join(wanted.select("id").distinct(), "id", "left_semi").select("id"), "to-erase")
            n = present.count()
            (control or Control()).check("erase")
            if n:
                self.flush()
                seq, self._next_seq = self._next_seq, self._next_seq + 1
                tombs = present.select("id", F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("tomb"), RT.no_attrs().alias("attrs"), RT.no_contents().alias("contents"))
                part = self._write_part(tombs)
                self._publish(replace(self.commit, number=self.commit.number + 1, parts=(*self.commit.parts, part), next_seq=self._next_seq))
                self.compact()
                self.refold()
            return {"requested": requested, "tombstoned": n, "absent": requested - n, "remaining": self.records().count()}

    def erase_where(self, name: str, text: str) -> dict[str, int]:
        """Erases records with any attribute ``name`` whose value, written as text, is
        ``text``; binary values never match."""
        hit = F.exists("attrs", lambda a: (a["name"] == name) & F.coalesce(_as_text(a) == text, F.lit(False)))
        return self.erase_ids(resolve.live(self._view()).where(hit).select("id"))

    def backup(self, to: Any) -> dict[str, int]:
        """A settled, verified copy at a place that must not exist yet."""
        if Files(self.spark, to).exists():
            raise Contention(f"{to} exists")
        with self._operation("backup"):
            self.sync()
            self.flush()
            return _copied(self.spark, self.files, to)

    seal = backup

    # -- figures

    def space_usage(self) -> dict[str, int]:
        live = {x for p in self.commit.parts for x in (p.path, p.stats)} | set(self.commit.folds)
        commits = _commits(self.files).values()
        kept = {x for c in commits for p in c.parts for x in (p.path, p.stats)} | {f for c in commits for f in c.folds}
        out = {"live": 0, "retained_only": 0, "unclassified": 0, "total": 0}
        for name, size in self.files.sizes():
            home = name.rpartition("/")[0]
            out["total"] += size
            out["live" if home in live else "retained_only" if home in kept else "unclassified"] += size
        return out | {"filesystem_free": self.files.free()}

    def health(self) -> dict[str, int]:
        c = self.commit
        return {"commit": c.number, "parts": len(c.parts), "rows": sum(p.rows for p in c.parts), "part_bytes": sum(p.bytes for p in c.parts), "fold_gen": c.fold_gen, "fold_files": len(c.folds), "staged_records": len(self._staged), "staged_bytes": self._staged_bytes, "next_seq": self._next_seq, "retained_commits": len(_commits(self.files)), "erased_sets": len(c.erased)} | self.dedup

    def metrics(self) -> dict[str, Any]:
        return {"operations": {k: dict(v) for k, v in self.counters.items()}, "dedup": dict(self.dedup)}

    def lifecycle_events_after(self, sequence: int, limit: int = 256) -> dict[str, Any]:
        rest = [e for e in self.events if e["sequence"] > sequence]
        oldest = self.events[0]["sequence"] if self.events else self._event + 1
        return {"events": rest[:limit], "gap": sequence + 1 < oldest and self._event > sequence, "latest": self._event}


def _copied(spark: SparkSession, source: Files, to: Any) -> dict[str, int]:
    """Copies a store to a draft beside ``to``, verifies it, and moves it there."""
    target = Files(spark, to)
    folder, _, last = target.root.rpartition("/")
    draft = Files(spark, f"{folder}/.{last}-{uuid.uuid4().hex}")
    names = [n for n, _ in source.sizes() if n not in ("_lock", "_staged.json") and not n.rpartition("/")[2].startswith(".")]
    try:
        source.copy(names, draft.root)
        report = open_snapshot(spark, draft.root).verify()
        draft.rename(target.root)
    except OSError as e:
        raise IoFailure(str(e)) from e
    finally:
        draft.delete("")
    return report


def restore(spark: SparkSession, source: Any, to: Any) -> dict[str, int]:
    """A verified copy of a backup at a place that must not exist yet."""
    if Files(spark, to).exists():
        raise Contention(f"{to} exists")
    return _copied(spark, Files(spark, source), to)


def _as_text(a: Any) -> Any:
    return F.coalesce(a["s"], a["i"].cast("string"), a["b"].cast("string"), a["u"].cast("string"), a["ts_ns"].cast("string"), a["f"].cast("string"))


def _size(id: str, attrs: list, contents: dict) -> int:
    """Bytes of a record if every piece of it were new, framing included."""
    size = len(id.encode()) + 64
    for n, v in attrs:
        size += len(n.encode()) + 16 + (len(v.raw.encode()) if v.tag == 0 else len(v.raw) if v.tag == 5 else 8)
    return size + sum(len(n.encode()) + len(b) + 64 for n, (b, _) in contents.items())


def _spans(body: bytes, how: Any) -> list:
    import base64

    spans = [(f, body[s : s + n]) for f, s, n in how.spans(body)] if isinstance(how, Carve) else how
    return [[f, base64.b64encode(x).decode()] for f, x in spans]


__all__ = ["Batch", "BudgetTooSmall", "Commit", "Part", "Snapshot", "Store", "WriteLimits", "classify", "open_snapshot", "read_commits", "recover_commit", "restore", "retained_commits", "verify_chain"]
