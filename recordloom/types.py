"""Records and their scalar values.

A record has an id, an ordered list of typed attributes (names may repeat, explicit
nulls count) and named contents. An attribute value is a struct of nullable slots
and a tag; floats keep their exact bits beside the double, because NaN payloads
don't survive the trip through Python and Parquet.
"""

from __future__ import annotations

import base64
import math
import re
import struct
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument

TAGS = {"str": 0, "int": 1, "float": 2, "bool": 3, "uint": 4, "binary": 5, "timestamp_ns": 6, "null": 7}
NAMES = {v: k for k, v in TAGS.items()}

ATTR = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("tag", T.ByteType()),
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("fbits", T.LongType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("u", T.DecimalType(20, 0)),
        T.StructField("bin", T.BinaryType()),
        T.StructField("ts_ns", T.LongType()),
    ]
)
OP = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lit", T.BinaryType()), T.StructField("piece", T.BinaryType()), T.StructField("len", T.LongType())])
LITERAL, PIECE = 0, 1
CONTENT = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("len", T.LongType()), T.StructField("pieces", T.IntegerType()), T.StructField("identity", T.BinaryType()), T.StructField("ops", T.ArrayType(OP))]
)
RECORD = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("tomb", T.BooleanType(), False), T.StructField("attrs", T.ArrayType(ATTR)), T.StructField("contents", T.ArrayType(CONTENT))]
)
FOLD = T.StructType([T.StructField("piece", T.BinaryType(), False), T.StructField("len", T.LongType()), T.StructField("bytes", T.BinaryType()), T.StructField("first_seq", T.LongType())])

#: The slot of an attribute struct that holds values of a tag.
SLOT = {0: "s", 1: "i", 2: "f", 3: "b", 4: "u", 5: "bin", 6: "ts_ns", 7: None}
SQL_TYPE = {0: "string", 1: "bigint", 2: "double", 3: "boolean", 4: "decimal(20,0)", 5: "binary", 6: "bigint", 7: "boolean"}


def bits_of(value: float) -> int:
    return struct.unpack("<q", struct.pack("<d", value))[0]


def float_of(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


@dataclass(frozen=True)
class Value:
    """A typed scalar. Floats are held as their signed 64 bits."""

    tag: int
    raw: Any = None

    @staticmethod
    def str(v: str) -> Value:
        return Value(0, v)

    @staticmethod
    def int(v: int) -> Value:
        if not -(1 << 63) <= v < 1 << 63:
            raise InvalidArgument("i64 out of range")
        return Value(1, v)

    @staticmethod
    def float(v: float) -> Value:
        return Value(2, bits_of(v))

    @staticmethod
    def bits(v: int) -> Value:
        return Value(2, v - (1 << 64) if v >= 1 << 63 else v)

    @staticmethod
    def bool(v: bool) -> Value:
        return Value(3, v)

    @staticmethod
    def uint(v: int) -> Value:
        if not 0 <= v < 1 << 64:
            raise InvalidArgument("u64 out of range")
        return Value(4, v)

    @staticmethod
    def binary(v: bytes) -> Value:
        return Value(5, bytes(v))

    @staticmethod
    def timestamp_ns(v: int) -> Value:
        return Value(6, Value.int(v).raw)

    @staticmethod
    def null() -> Value:
        return Value(7)

    @staticmethod
    def of(v: Any) -> Value:
        """By Python type: bool, int (beyond i64: unsigned), float, str, bytes, None."""
        if isinstance(v, Value):
            return v
        if v is None:
            return Value.null()
        if isinstance(v, bool):
            return Value.bool(v)
        if isinstance(v, int):
            return Value.int(v) if -(1 << 63) <= v < 1 << 63 else Value.uint(v)
        if isinstance(v, float):
            return Value.float(v)
        if isinstance(v, str):
            return Value.str(v)
        if isinstance(v, bytes | bytearray | memoryview):
            return Value.binary(bytes(v))
        raise InvalidArgument(f"not a scalar: {type(v).__name__}")

    @property
    def python(self) -> Any:
        return float_of(self.raw) if self.tag == 2 else self.raw

    def row(self, name: str) -> tuple:
        slots = dict.fromkeys(("s", "i", "f", "fbits", "b", "u", "bin", "ts_ns"))
        if self.tag == 2:
            slots["f"], slots["fbits"] = self.python, self.raw
        elif self.tag == 4:
            slots["u"] = Decimal(self.raw)
        elif self.tag != 7:
            slots[SLOT[self.tag]] = self.raw
        return (name, self.tag, *slots.values())

    @staticmethod
    def from_row(r: Any) -> Value:
        tag = r["tag"]
        if tag == 2:
            return Value(2, bits_of(r["f"]) if r["fbits"] is None else r["fbits"])
        if tag == 4:
            return Value(4, int(r["u"]))
        if tag == 5:
            return Value(5, bytes(r["bin"]))
        return Value(tag, None if tag == 7 else r[SLOT[tag]])

    # the wire form of the query contract

    def encode(self) -> dict[str, Any]:
        v = self.raw
        kind, key, form = {
            0: ("string", "value", lambda: v),
            1: ("i64", "decimal", lambda: str(v)),
            2: ("f64", "bitsHex", lambda: f"{v % (1 << 64):016x}"),
            3: ("bool", "value", lambda: v),
            4: ("u64", "decimal", lambda: str(v)),
            5: ("binary", "base64", lambda: base64.b64encode(v).decode()),
            6: ("timestampNs", "decimal", lambda: str(v)),
            7: ("null", "", None),
        }[self.tag]
        return {"type": kind, key: form()} if form else {"type": kind}

    @staticmethod
    def decode(x: dict[str, Any]) -> Value:
        kind = x.get("type")
        if kind == "string" and isinstance(x.get("value"), str):
            return Value.str(x["value"])
        if kind == "bool" and isinstance(x.get("value"), bool):
            return Value.bool(x["value"])
        if kind in ("i64", "u64", "timestampNs"):
            text = x.get("decimal")
            if not isinstance(text, str) or not re.fullmatch(r"0|-?[1-9][0-9]*", text):
                raise InvalidArgument("decimal must be canonical base 10")
            return {"i64": Value.int, "u64": Value.uint, "timestampNs": Value.timestamp_ns}[kind](int(text))
        if kind == "f64":
            text = x.get("bitsHex")
            if not isinstance(text, str) or not re.fullmatch(r"[0-9a-f]{16}", text):
                raise InvalidArgument("bitsHex must be sixteen lower-case hexadecimal digits")
            return Value.bits(int(text, 16))
        if kind == "binary" and isinstance(x.get("base64"), str):
            try:
                return Value.binary(base64.b64decode(x["base64"], validate=True))
            except ValueError as e:
                raise InvalidArgument("base64 is malformed") from e
        if kind == "null":
            return Value.null()
        raise InvalidArgument(f"not a scalar: {x!r}")

    @property
    def nan(self) -> bool:
        return self.tag == 2 and math.isnan(self.python)


@dataclass
class Record:
    """What ``get`` returns: attributes in order, contents by name (None: metadata)."""

    id: str
    attrs: list[tuple[str, Value]] = field(default_factory=list)
    contents: dict[str, Any] = field(default_factory=dict)


def attr_arrays(records: list[list[tuple[str, Value]] | None]) -> pa.Array:
    """Lists of (name, value) as an Arrow array of type ``array<ATTR>``, a column at a
    time; None is null."""
    ends, flat = [0], []
    for r in records:
        flat += r or ()
        ends.append(len(flat))
    tags, raws = [v.tag for _, v in flat], [v.raw for _, v in flat]
    held = set(tags)

    def slot(tag: int, type: pa.DataType, form: Any = None) -> pa.Array:
        if tag not in held:
            return pa.nulls(len(flat), type)
        return pa.array([(form(x) if form else x) if t == tag else None for x, t in zip(raws, tags)], type)

    columns = {"name": pa.array([n for n, _ in flat], pa.string()), "tag": pa.array(tags, pa.int8()), "s": slot(0, pa.string()), "i": slot(1, pa.int64()), "f": slot(2, pa.float64(), float_of), "fbits": slot(2, pa.int64()), "b": slot(3, pa.bool_()), "u": slot(4, pa.decimal128(20, 0), Decimal), "bin": slot(5, pa.binary()), "ts_ns": slot(6, pa.int64())}
    values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in records], pa.bool_()))


def attr(name: Column | str, tag: str, value: Column | None = None) -> Column:
    """An attribute struct from a column, for building records out of tables."""
    t = TAGS[tag]
    name = F.lit(name) if isinstance(name, str) else name
    slots = {f.name: F.lit(None).cast(f.dataType) for f in ATTR.fields[2:]}
    if tag == "float":
        slots["f"] = value.cast("double")  # its bits follow from it: NaN is canonical here
    elif tag != "null":
        slots[SLOT[t]] = value.cast(ATTR[SLOT[t]].dataType)
    return F.struct(name.alias("name"), F.lit(t).cast("byte").alias("tag"), *(c.alias(k) for k, c in slots.items()))


def no_attrs() -> Column:
    return F.array().cast(T.ArrayType(ATTR))


def no_contents() -> Column:
    return F.array().cast(T.ArrayType(CONTENT))
