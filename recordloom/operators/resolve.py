"""Newest wins: what every read begins with.

All forms use a window, not ``max_by(struct(*))``: Catalyst prunes columns below a
window, turns ``row_number = 1`` into a per-partition limit before the shuffle, and
pushes predicates on id (the partition key) to the scan, but no others, so a
predicate never uncovers an older version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMTABLE_SEQ = (1 << 63) - 1


def candidates(versions: DataFrame, id: str | list[str] = "id", seq: str = "seq") -> DataFrame:
    """The versions whose sequence is their id's greatest: more than one only if they
    share it. For tables of many versions an id, ahead of ``newest``, whose window
    sorts all rows whole in the tasks that read them: here a hash of ids is what a
    task holds, and the rows are spread by id and sequence, hot ids too."""
    keys = [id] if isinstance(id, str) else id
    top = versions.groupBy(*keys).agg(F.max(seq).alias("__top"))
    top = top.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), "__top").hint("shuffle_hash")
    same = F.col(seq).eqNullSafe(F.col("__top"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return versions.join(top, same, "left_semi")


def newest(versions: DataFrame, id: str | list[str] = "id", seq: str = "seq") -> DataFrame:
    """The newest version of each id, tombstones included."""
    w = Window.partitionBy(id).orderBy(F.desc(seq))
    return versions.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def live(versions: DataFrame, id: str = "id", seq: str = "seq", tomb: str = "tomb") -> DataFrame:
    """The newest version of each id that isn't a tombstone."""
    return newest(versions, id, seq).where(~F.col(tomb))


def overlay(committed: DataFrame, staged: DataFrame) -> DataFrame:
    """Committed versions with staged ones on top: a writer reads its own writes.
    The last staged version of an id stands."""
    top = newest(staged)
    return committed.unionByName(top.withColumn("seq", F.lit(MEMTABLE_SEQ)))


def bounded(versions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Versions with id in [start, end), a filter below any window over id."""
    if start is not None:
        versions = versions.where(F.col("id") >= start)
    if end is not None:
        versions = versions.where(F.col("id") < end)
    return versions


def statistics(versions: DataFrame, id: str = "id", seq: str = "seq", tomb: str = "tomb") -> DataFrame:
    """One row: physical_rows, superseded_rows, tombstones, live_rows. Aggregated per
    id with partial aggregation, so a hot id is reduced before the shuffle."""
    per = versions.groupBy(id).agg(F.count("*").alias("n"), F.max_by(tomb, seq).alias("dead"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("physical_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("superseded_rows"),
        F.coalesce(F.sum(F.col("dead").cast("long")), F.lit(0)).alias("tombstones"),
        F.coalesce(F.sum((~F.col("dead")).cast("long")), F.lit(0)).alias("live_rows"),
    )


def scope(versions: DataFrame, part: str = "part") -> DataFrame:
    """Rows in bounds per part, before resolution."""
    return versions.groupBy(part).agg(F.count("*").alias("rows_in_bounds"))
