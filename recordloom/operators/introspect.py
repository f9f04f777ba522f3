"""What a store holds: schema, liveness, distributions, compaction plans."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetTooSmall, InvalidArgument
from ..types import NAMES
from . import content


@dataclass(frozen=True)
class Schema:
    """Attribute names with their types, and content names, all sorted. A discovered
    schema may include fields that only superseded versions have."""

    attributes: tuple[tuple[str, tuple[str, ...]], ...]
    contents: tuple[str, ...]
    may_include_shadowed_fields: bool = False


def attribute_types(records: DataFrame) -> DataFrame:
    """Distinct (name, tag) of all attributes."""
    return records.select(F.explode("attrs").alias("a")).select("a.name", "a.tag").distinct()


def schema_of(pairs: Iterable[tuple[str, int]], contents: Iterable[str], superset: bool = False) -> Schema:
    found: dict[str, list[int]] = {}
    for name, tag in pairs:
        found.setdefault(name, []).append(tag)
    attributes = tuple((n, tuple(NAMES[t] for t in sorted(found[n]))) for n in sorted(found, key=str.encode))
    return Schema(attributes, tuple(sorted(contents, key=str.encode)), superset)


def discover(records: DataFrame, superset: bool = False) -> Schema:
    """Collects names and types only: as many rows as there are columns."""
    names = records.select(F.explode("contents").alias("c")).select(F.col("c.name").alias("name")).distinct().collect()
    return schema_of(((r["name"], r["tag"]) for r in attribute_types(records).collect()), (r["name"] for r in names), superset)


def duplicate_occurrences(records: DataFrame) -> DataFrame:
    """(id, duplicates): repeats of a name and type beyond the first."""
    names = F.transform("attrs", lambda a: F.struct(a["name"], a["tag"]))
    return records.select("id", (F.size("attrs") - F.size(F.array_distinct(names))).alias("duplicates"))


def liveness(live_records: DataFrame, fold: DataFrame) -> dict[str, int]:
    live = content.live_pieces(live_records).withColumn("live", F.lit(True))
    size = F.col("len")
    r = (
        fold.join(live, "piece", "left")
        .agg(
            F.coalesce(F.sum(F.when(F.col("live"), size)), F.lit(0)).alias("live_bytes"),
            F.coalesce(F.sum(F.when(F.col("live").isNull(), size)), F.lit(0)).alias("dead_bytes"),
            F.count("live").alias("live_pieces"),
            F.count_if(F.col("live").isNull()).alias("dead_pieces"),
        )
        .first()
    )
    return r.asDict()


def nearest_rank(values: list[int], percent: int) -> int:
    """The smallest value with at least ``percent`` per cent at or below it."""
    v = sorted(values)
    return v[max(0, -(-len(v) * percent // 100) - 1)] if v else 0


def distribution(rows: list[int], sizes: list[int]) -> dict[str, dict[str, int]]:
    out = {}
    for name, v in (("rows", rows), ("bytes", sizes)):
        out[name] = {"min": min(v, default=0), "p50": nearest_rank(v, 50), "p95": nearest_rank(v, 95), "max": max(v, default=0)}
    return out


def plan_compaction(parts: list[tuple[int, int]], max_parts: int, max_rows: int, max_bytes: int) -> tuple[int, int] | None:
    """The widest run of neighbouring parts within the budget, the oldest of equals:
    (first, length). None with fewer than two parts."""
    if max_parts < 2 or max_rows < 1 or max_bytes < 1:
        raise InvalidArgument("a compaction budget admits at least two parts, a row and a byte")
    if len(parts) < 2:
        return None
    best = None
    for lo in range(len(parts) - 1):
        rows = size = 0
        for hi in range(lo, min(len(parts), lo + max_parts)):
            rows, size = rows + parts[hi][0], size + parts[hi][1]
            if rows > max_rows or size > max_bytes:
                break
            if hi > lo and (best is None or hi - lo + 1 > best[1]):
                best = (lo, hi - lo + 1)
    if best is None:
        pairs = [(a[1] + b[1], a[0] + b[0]) for a, b in zip(parts, parts[1:])]
        size, rows = min(pairs)
        raise BudgetTooSmall(rows, size)
    return best


def zones(records: DataFrame) -> DataFrame:
    """Least and greatest value per numeric (name, tag), and whether NaN spoils them:
    floats as least_f and greatest_f, the whole-number types, exactly, as least_n and
    greatest_n (decimal)."""
    return zones_by(records.select(F.explode(zone_entries()).alias("z")).where(F.col("z.tag").isin(1, 2, 3, 4, 6)))


def zone_entries(attrs: str = "attrs") -> Column:
    """Of each attribute: name, tag, and its value where its type has an order, as a
    whole number or a float."""

    def entry(a: Column) -> Column:
        whole = F.coalesce(*(a[c].cast("decimal(20,0)") for c in ("i", "u", "ts_ns")), a["b"].cast("int").cast("decimal(20,0)"))
        return F.struct(a["name"].alias("name"), a["tag"].cast("int").alias("tag"), whole.alias("n"), a["f"].alias("f"))

    return F.transform(attrs, entry)


def zones_by(entries: DataFrame, *keys: str) -> DataFrame:
    """Zones of ``entries`` (keys, z), by keys and (name, tag)."""
    real = F.when(~F.isnan("z.f"), F.col("z.f"))
    bounds = [F.min("z.n").alias("least_n"), F.max("z.n").alias("greatest_n"), F.min(real).alias("least_f"), F.max(real).alias("greatest_f")]
    spoilt = F.max(F.isnan(F.coalesce("z.f", F.lit(0.0)))).alias("poisoned")
    return entries.groupBy(*keys, F.col("z.name").alias("name"), F.col("z.tag").alias("tag")).agg(*bounds, spoilt)
