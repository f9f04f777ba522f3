"""The lens: records as a flat, typed table.

Columns are ``id``; contents by name (``body``, else ``content.<name>``); then
attributes by name and type. A name with one type other than null keeps its name;
others become ``name#type``, with ``#2``, ``#3``… when taken. A cell holds the first
occurrence of its name and type; null marks absence, and an explicit null shows as
true in its ``name#null`` column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators.introspect import Schema
from ..operators.predicates import first_occurrence
from ..types import SLOT, TAGS


def columns(schema: Schema) -> list[tuple[str, str, str | None, str | None]]:
    """(column, kind, name, type) in order; kind is id, content or attr."""
    out: list[tuple[str, str, str | None, str | None]] = [("id", "id", None, None)]
    taken = {"id"}
    for name in schema.contents:
        col = "body" if name == "body" else f"content.{name}"
        taken.add(col)
        out.append((col, "content", name, None))
    for name, types in schema.attributes:
        for t in types:
            col = name if len(types) == 1 and t != "null" else f"{name}#{t}"
            if col in taken:
                col = f"{name}#{t}"
            base, n = col, 2
            while col in taken:
                col, n = f"{base}#{n}", n + 1
            taken.add(col)
            out.append((col, "attr", name, t))
    return out


def cell(name: str, type: str) -> Column:
    got = first_occurrence(name, TAGS[type])
    slot = SLOT[TAGS[type]]
    return F.when(got.isNotNull(), F.lit(True)) if slot is None else got[slot]


def flat(records: DataFrame, schema: Schema, contents: Callable[[str], DataFrame] | None = None, project: list[str] | None = None) -> DataFrame:
    """The flat table. Contents are joined in only where projected, so a query that
    selects none never reads the fold."""
    known = columns(schema)
    if project is not None:
        missing = [c for c in project if c not in {k[0] for k in known}]
        if missing:
            raise InvalidArgument(f"unknown columns {missing}")
        known = [k for c in project for k in known if k[0] == c]
    bodies = [(c, n) for c, kind, n, _ in known if kind == "content"]
    cells = [F.col("id") if kind == "id" else F.lit(None).alias(c) if kind == "content" else cell(n, t).alias(c) for c, kind, n, t in known]
    if not bodies:
        return records.select(*cells)
    out = records.select(F.col("id").alias("__id"), *(x for x, k in zip(cells, known) if k[1] != "content"))
    for i, (c, n) in enumerate(bodies):
        out = out.join(contents(n).select(F.col("id").alias(f"__id{i}"), F.col("body").alias(c)), F.col("__id") == F.col(f"__id{i}"), "left").drop(f"__id{i}")
    names = [k[0] for k in known]
    if "id" not in out.columns and "id" in names:
        out = out.withColumn("id", F.col("__id"))
    return out.select(*(F.col(f"`{c}`") for c in names))


def shadowed(records: DataFrame) -> DataFrame:
    """One row: occurrences that no cell shows."""
    names = F.transform("attrs", lambda a: F.struct(a["name"], a["tag"]))
    return records.agg(F.coalesce(F.sum(F.size("attrs") - F.size(F.array_distinct(names))), F.lit(0)).alias("shadowed_occurrences"))
