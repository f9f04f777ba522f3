"""Typed predicates over records; a scan takes their conjunction.

An attribute predicate sees the first occurrence of its name with its value's type
and is false where there is none, ``ne`` included. Floats are equal by bits and
ordered by IEEE rules. A null literal only knows ``eq``.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..types import SLOT, Value, bits_of

OPS = ("eq", "lt", "gt", "ne", "gte", "lte")


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"lt": a < b, "eq": a == b, "gt": a > b, "lte": a <= b, "ne": a != b, "gte": a >= b}[op]


def literal(value: Value) -> Column:
    """A literal of the slot a value lives in (a float's double)."""
    if value.tag == 4:
        return F.lit(str(value.raw)).cast("decimal(20,0)")
    if value.tag == 5:
        return F.lit(bytearray(value.raw))
    if value.tag == 2:
        return F.lit(value.python)
    return F.lit(value.raw)


def _same_bits(x: Column, v: Value) -> Column:
    """Whether a float, NaN being canonical, has the bits of ``v``."""
    if v.nan:
        return F.isnan(x) & F.lit(v.raw == bits_of(float("nan")))
    if v.python == 0:
        return (x == 0) & ((x.cast("string") == "-0.0") == F.lit(v.raw != 0))
    return ~F.isnan(x) & (x == F.lit(v.python))


def first_occurrence(name: str, tag: int, attrs: Column | None = None) -> Column:
    """The first attribute of a name and type, null without one."""
    attrs = F.col("attrs") if attrs is None else attrs
    return F.get(F.filter(attrs, lambda a: (a["name"] == name) & (a["tag"] == tag)), 0)


@dataclass(frozen=True)
class Id:
    op: str
    value: str

    def column(self) -> Column:
        return _compare(self.op, F.col("id"), F.lit(self.value))

    def key(self) -> bytes:
        return _packed(b"\0", self.op, self.value.encode())


@dataclass(frozen=True)
class Attr:
    name: str
    op: str
    value: Value

    def column(self) -> Column:
        v = self.value
        got = first_occurrence(self.name, v.tag)
        if v.tag == 7:
            test = got.isNotNull() if self.op == "eq" else F.lit(False)
        elif v.tag == 2 and self.op in ("eq", "ne"):
            same = F.when(got["fbits"].isNotNull(), got["fbits"] == F.lit(v.raw)).when(got["f"].isNotNull(), _same_bits(got["f"], v))
            test = same if self.op == "eq" else ~same
        elif v.tag == 2:
            x = got["f"]
            test = F.lit(False) if v.nan else ~F.isnan(x) & _compare(self.op, x, F.lit(v.python))
        else:
            test = _compare(self.op, got[SLOT[v.tag]], literal(v))
        return F.coalesce(test, F.lit(False))

    def key(self) -> bytes:
        return _packed(b"\1", self.op, self.name.encode(), repr((self.value.tag, self.value.raw)).encode())


@dataclass(frozen=True)
class AttrExists:
    name: str
    present: bool = True

    def column(self) -> Column:
        has = F.coalesce(F.exists("attrs", lambda a: a["name"] == self.name), F.lit(False))
        return has if self.present else ~has

    def key(self) -> bytes:
        return _packed(b"\2", str(self.present), self.name.encode())


@dataclass(frozen=True)
class ContentExists:
    name: str
    present: bool = True

    def column(self) -> Column:
        has = F.coalesce(F.exists("contents", lambda c: c["name"] == self.name), F.lit(False))
        return has if self.present else ~has

    def key(self) -> bytes:
        return _packed(b"\3", str(self.present), self.name.encode())


def zone(p: Id | Attr | AttrExists | ContentExists) -> Column | None:
    """Of a file's statistics (column zones): whether any of its rows can satisfy
    ``p``; None where zones say nothing. An attribute no row has satisfies nothing,
    and a NaN neither equals nor orders, but by its bits."""
    if not isinstance(p, Attr):
        return None
    t, v = p.value.tag, p.value
    if t in (0, 5, 7):
        return F.exists("zones", lambda z: (z["name"] == p.name) & (z["tag"] == t))
    kind = "f" if t == 2 else "n"
    if t == 2 and (v.nan or p.op in ("eq", "ne")):
        return F.exists("zones", lambda z: (z["name"] == p.name) & (z["tag"] == t))
    x = F.lit(v.python) if t == 2 else F.lit(str(int(v.raw))).cast("decimal(20,0)")

    def holds(z: Column) -> Column:
        low, high = z[f"least_{kind}"], z[f"greatest_{kind}"]
        test = {"eq": (low <= x) & (x <= high), "lt": low < x, "lte": low <= x, "gt": high > x, "gte": high >= x, "ne": (low != x) | (high != x)}[p.op]
        return (z["name"] == p.name) & (z["tag"] == t) & F.coalesce(test, F.lit(False))

    return F.exists("zones", holds)


Predicate = Id | Attr | AttrExists | ContentExists


def _packed(*parts: bytes | str) -> bytes:
    raw = [p.encode() if isinstance(p, str) else p for p in parts]
    return b"".join(struct.pack("<Q", len(p)) + p for p in raw)


def validate(p: Predicate) -> None:
    if isinstance(p, Id | Attr) and p.op not in OPS:
        raise InvalidArgument(f"unknown comparison {p.op!r}")
    if not isinstance(p, Id) and not p.name:
        raise InvalidArgument("a predicate's field name is empty")


def conjunction(predicates: list[Predicate]) -> Column:
    return reduce(lambda a, b: a & b, (p.column() for p in predicates), F.lit(True))


def decode(x: dict) -> Predicate:
    """A predicate of the wire form."""
    kind = x.get("kind") or x.get("type")
    try:
        if kind == "id":
            p: Predicate = Id(x["op"], x["value"])
        elif kind == "attr":
            p = Attr(x["name"], x["op"], Value.decode(x["value"]))
        elif kind in ("attrExists", "contentExists"):
            p = (AttrExists if kind == "attrExists" else ContentExists)(x["name"], bool(x.get("present", True)))
        else:
            raise InvalidArgument(f"unknown predicate {kind!r}")
    except KeyError as e:
        raise InvalidArgument(f"a predicate lacks {e.args[0]!r}") from e
    validate(p)
    return p
