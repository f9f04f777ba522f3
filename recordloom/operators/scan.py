"""Structured scan: live records in id order, page by page, within work budgets.

Budgets decide where a page ends, so they are running sums in id order. A page first
looks at a prefix of ids that is likely to be enough, by the store's marks, and at a
larger one only if it wasn't, so its work follows its budgets and not the store. A
page is all or nothing.
"""

from __future__ import annotations

import hashlib
import struct
import time
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..control import Control
from ..errors import InvalidArgument
from ..types import Record, Value
from . import content, predicates, resolve

MAX_LIMIT, MAX_EXAMINED, MAX_RESOLUTION = 10_000, 1_000_000, 10_000_000
_VERSION = 1


@dataclass(frozen=True)
class ScanRequest:
    start: str | None = None
    end: str | None = None
    reverse: bool = False
    limit: int = 100
    cursor: str | None = None
    predicates: tuple[predicates.Predicate, ...] = ()
    #: Attribute names to return, all occurrences; None: all.
    attrs: tuple[str, ...] | None = None
    #: (content name, "metadata" | "bytes") to return, in this order.
    contents: tuple[tuple[str, str], ...] = ()
    max_examined: int = 10_000
    max_resolution_entries: int = 1_000_000
    max_reconstructed_bytes: int = 32 << 20
    control: Control | None = field(default=None, compare=False)

    def validate(self) -> None:
        for name, top in (("limit", MAX_LIMIT), ("max_examined", MAX_EXAMINED), ("max_resolution_entries", MAX_RESOLUTION)):
            if not 1 <= getattr(self, name) <= top:
                raise InvalidArgument(f"{name} must be 1 to {top}")
        if self.max_reconstructed_bytes < 1:
            raise InvalidArgument("max_reconstructed_bytes must be positive")
        if self.start is not None and self.end is not None and self.start.encode() >= self.end.encode():
            raise InvalidArgument("the id range is empty or inverted")
        names = [n for n, _ in self.contents]
        if len(set(names)) < len(names) or "" in names:
            raise InvalidArgument("content names must be given once and not be empty")
        if any(how not in ("metadata", "bytes") for _, how in self.contents):
            raise InvalidArgument("content is projected as metadata or bytes")
        for p in self.predicates:
            predicates.validate(p)

    def fingerprint(self) -> bytes:
        """Of bounds, direction and predicates: what a cursor is bound to."""
        h = hashlib.sha256(b"recordloom-scan-1")
        for bound in (self.start, self.end):
            h.update(b"\0" if bound is None else b"\1" + struct.pack("<Q", len(bound.encode())) + bound.encode())
        h.update(bytes([self.reverse]))
        for p in self.predicates:
            h.update(p.key())
        return h.digest()[:16]


def encode_cursor(request: ScanRequest, last: str) -> str:
    raw = bytes([_VERSION, request.reverse]) + request.fingerprint() + struct.pack("<I", len(last.encode())) + last.encode()
    return (raw + hashlib.sha256(raw).digest()[:8]).hex()


def decode_cursor(request: ScanRequest) -> str | None:
    """The last id a cursor has passed; damage or another request's cursor raises."""
    if request.cursor is None:
        return None
    try:
        raw = bytes.fromhex(request.cursor)
    except ValueError as e:
        raise InvalidArgument("the cursor is malformed") from e
    if len(raw) < 30 or hashlib.sha256(raw[:-8]).digest()[:8] != raw[-8:] or request.cursor != raw.hex():
        raise InvalidArgument("the cursor is damaged")
    if raw[0] != _VERSION or struct.unpack("<I", raw[18:22])[0] != len(raw) - 30:
        raise InvalidArgument("the cursor has another form")
    if raw[1] != request.reverse or raw[2:18] != request.fingerprint():
        raise InvalidArgument("the cursor belongs to another request")
    return raw[22:-8].decode()


@dataclass
class ScanStats:
    duration_ns: int = 0
    examined: int = 0
    returned: int = 0
    duplicate_attr_occurrences: int = 0
    content_values_reconstructed: int = 0
    reconstructed_bytes: int = 0
    reconstruction_budget_exhausted: bool = False
    physical_rows: int = 0
    superseded_rows: int = 0
    tombstones: int = 0
    resolution_budget_exhausted: bool = False


@dataclass
class ScanPage:
    rows: list[Record]
    next: str | None
    stats: ScanStats


@dataclass(frozen=True)
class ScanExplanation:
    start: str | None
    end: str | None
    reverse: bool
    limits: dict[str, int]
    predicates: int
    attributes: tuple[str, ...] | None
    contents: tuple[tuple[str, str], ...]
    parts_considered: int
    parts_with_rows: int
    rows_in_bounds: int
    memtable_entries_in_bounds: int


class Table:
    """Versions as a plain table, for a scan: every prefix is the whole."""

    def __init__(self, versions: DataFrame):
        self.versions, self.spark = versions, versions.sparkSession

    def _view(self, start: str | None, end: str | None, tests: tuple = ()) -> DataFrame:
        return resolve.bounded(self.versions, start, end)

    def mark(self, start: str | None, end: str | None, reverse: bool, rows: int) -> str | None:
        return None


def _ends(request: ScanRequest) -> tuple[str | None, str | None]:
    """Ids [start, end) that a page may return: bounds, id predicates and the cursor."""
    last = decode_cursor(request)
    start, end = request.start, request.end

    def above(x: str) -> None:
        nonlocal start
        start = x if start is None or x.encode() > start.encode() else start

    def below(x: str) -> None:
        nonlocal end
        end = x if end is None or x.encode() < end.encode() else end

    for p in request.predicates:
        if isinstance(p, predicates.Id):
            if p.op in ("eq", "gte", "gt"):
                above(p.value + "\0" * (p.op == "gt"))
            if p.op in ("eq", "lte", "lt"):
                below(p.value + "\0" * (p.op != "lt"))
    if last is not None and request.reverse:
        below(last)
    elif last is not None:
        above(last + "\0")  # the least string after it
    return start, end


def explain(source: Any, request: ScanRequest, parts: int) -> ScanExplanation:
    """What a scan would consider; resolves nothing and tests no predicate. ``source``
    is a snapshot, or versions with a column part, -1 for staged rows."""
    request.validate()
    source = Table(source) if isinstance(source, DataFrame) else source
    start, end = request.start, request.end
    last = decode_cursor(request)
    if last is not None:
        start, end = (start, last) if request.reverse else (last + "\0", end)
    counts = {r["part"]: r["rows_in_bounds"] for r in resolve.scope(source._view(start, end)).collect()}
    staged = counts.pop(-1, 0)
    limits = {k: getattr(request, k) for k in ("limit", "max_examined", "max_resolution_entries", "max_reconstructed_bytes")}
    return ScanExplanation(request.start, request.end, request.reverse, limits, len(request.predicates), request.attrs, request.contents, parts, len(counts), sum(counts.values()), staged)


def scan(source: Any, fold: DataFrame | None, request: ScanRequest, erased: DataFrame | None = None) -> ScanPage:
    """One page of live records matching all predicates. ``source`` is a snapshot, or
    a table of versions."""
    began = time.monotonic_ns()
    request.validate()
    control = request.control or Control()
    control.check("scan")
    source = Table(source) if isinstance(source, DataFrame) else source
    start, end = _ends(request)
    rows = 4 * min(request.limit, request.max_examined, request.max_resolution_entries) + 1024
    page = None
    with control.watching(source.spark):
        while page is None:
            bound = source.mark(start, end, request.reverse, rows)
            first, last = (bound + "\0", end) if bound is not None and request.reverse else (start, end if bound is None else bound)
            page = _page(source._view(first, last, request.predicates), fold, request, erased, control, bound is not None)
            rows *= 16
    page.stats.duration_ns = time.monotonic_ns() - began
    control.check("scan")
    return page


def _page(inside: DataFrame, fold: DataFrame | None, request: ScanRequest, erased: DataFrame | None, control: Control, cut: bool) -> ScanPage | None:
    """A page from the versions ``inside``; None if they are ``cut`` and don't decide
    where it ends."""
    way = (lambda c: F.desc(c)) if request.reverse else (lambda c: F.asc(c))
    groups = inside.groupBy("id").agg(F.count("*").alias("n"), F.max_by("tomb", "seq").alias("dead"))
    groups = groups.orderBy(way("id")).limit(request.max_resolution_entries + 1)
    w = Window.orderBy(way("id")).rowsBetween(Window.unboundedPreceding, 0)  # over a prefix
    groups = groups.select("id", "n", "dead", F.sum("n").over(w).alias("rows"), F.sum((~F.col("dead")).cast("long")).over(w).alias("alive"), F.row_number().over(Window.orderBy(way("id"))).alias("rank"))
    allowed = (F.col("rows") <= request.max_resolution_entries) | (F.col("rank") == 1)
    reached = allowed & (F.col("alive") <= request.max_examined)
    edge = groups.agg(F.max_by("id", F.when(reached, F.col("rank"))).alias("last"), F.max(F.when(reached, F.col("rank"))).alias("rank"), F.max(F.when(allowed, F.col("rank"))).alias("allowed"), F.count("*").alias("ids")).first()
    if edge["rank"] is None:
        return None if cut else ScanPage([], None, ScanStats())
    beyond_edge = lambda last: F.col("id") < last if request.reverse else F.col("id") > last
    window = inside.where(~beyond_edge(edge["last"]))
    hits = resolve.live(window).where(predicates.conjunction(list(request.predicates)))
    wanted = [n for n, how in request.contents if how == "bytes"]
    size = F.aggregate(F.filter("contents", lambda c: c["name"].isin(wanted)), F.lit(0).cast("long"), lambda a, c: a + c["len"]) if wanted else F.lit(0).cast("long")
    rows = hits.withColumn("__bytes", size).orderBy(way("id")).limit(request.limit).collect()
    control.check("scan")
    taken, total, crossed = [], 0, False
    for r in rows:
        if taken and total + r["__bytes"] > request.max_reconstructed_bytes:
            crossed = True
            break
        taken.append(r)
        total += r["__bytes"]
    full = len(taken) == request.limit or crossed
    if cut and not full and edge["rank"] == edge["ids"]:
        return None  # neither the limit nor a budget was met
    last = taken[-1]["id"] if full else edge["last"]
    work = groups.agg(
        *(F.coalesce(F.sum(F.when(~beyond_edge(last), x)), F.lit(0)).alias(name) for name, x in (("rows", F.col("n")), ("dead", F.col("dead").cast("long")), ("ids", F.lit(1)))),
        F.count_if(beyond_edge(last)).alias("beyond"),
    ).first()
    more = cut or work["beyond"] > 0
    bodies: dict[tuple[str, str], bytes] = {}
    if wanted and taken:
        if fold is None:
            raise InvalidArgument("this source has no content")
        bodies = _bodies(window, [r["id"] for r in taken], wanted, fold, erased)
    page = [_record(r, request, bodies) for r in taken]
    stats = ScanStats(
        examined=work["ids"] - work["dead"],
        returned=len(page),
        duplicate_attr_occurrences=sum(len(r.attrs) - len({(n, v.tag) for n, v in r.attrs}) for r in page),
        content_values_reconstructed=len(bodies),
        reconstructed_bytes=sum(map(len, bodies.values())),
        reconstruction_budget_exhausted=crossed,
        physical_rows=work["rows"],
        superseded_rows=work["rows"] - work["ids"],
        tombstones=work["dead"],
        resolution_budget_exhausted=bool(edge["allowed"] == edge["rank"] and more and not full),
    )
    return ScanPage(page, encode_cursor(request, last) if more else None, stats)


def _bodies(versions: DataFrame, ids: list[str], names: list[str], fold: DataFrame, erased: DataFrame | None) -> dict[tuple[str, str], bytes]:
    """Bytes of the named contents of a page's records (at most its limit)."""
    programs = resolve.live(versions.where(F.col("id").isin(ids))).select("id", F.explode("contents").alias("c"))
    programs = programs.where(F.col("c.name").isin(names)).select("id", F.col("c.name").alias("name"), F.col("c.identity").alias("identity"), F.col("c.ops").alias("ops"))
    test = None
    if erased is not None:
        used = programs.select(F.explode("ops").alias("o")).select(F.col("o.piece").alias("piece")).distinct()
        gone = [bytes(r["piece"]) for r in used.join(erased, "piece", "left_semi").collect()]
        test = F.col("op.piece").isin(gone) if gone else F.lit(False)
    return {(r["id"], r["name"]): bytes(r["body"]) for r in content.reconstruct(programs, fold, ["id", "name"], test).collect()}


def _record(r: Any, request: ScanRequest, bodies: dict[tuple[str, str], bytes]) -> Record:
    attrs = [(a["name"], Value.from_row(a)) for a in r["attrs"] or [] if request.attrs is None or a["name"] in request.attrs]
    known = {c["name"]: c for c in r["contents"] or []}
    contents: dict[str, Any] = {}
    for name, how in request.contents:
        c = known.get(name)
        if c is None:
            contents[name] = {"present": False}
            continue
        contents[name] = {"present": True, "len": c["len"], "pieces": c["pieces"], "identity": bytes(c["identity"]).hex()}
        if how == "bytes":
            contents[name]["bytes"] = bodies[r["id"], name]
    return Record(r["id"], attrs, contents)


def pages(source: Any, fold: DataFrame | None, request: ScanRequest, erased: DataFrame | None = None):
    """All pages; an empty page with a cursor is legal progress."""
    while True:
        page = scan(source, fold, request, erased)
        yield page
        if page.next is None:
            return
        request = replace(request, cursor=page.next)


def prefix_upper_bound(prefix: str) -> str | None:
    """The least string greater than all with a prefix, or None if there is none: the
    last code point that can grow does, stepping over the surrogates."""
    points = [ord(c) for c in prefix]
    while points:
        p = points.pop()
        if p < 0x10FFFF:
            p = 0xE000 if p == 0xD7FF else p + 1
            return "".join(map(chr, [*points, p]))
    return None
