"""Ranges of neighbouring rows, in the order of doc_id and, within one doc_id, of a
hash of the text, so that an id that a third of all rows have is cut as well.

Cuts are quantiles, found in two steps (of the whole, then within each coarse range),
and hot ids get cuts of their own. The driver holds one cut a range: sixteen bytes
for each RANGE bytes of text, some hundred megabytes for 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import MAX_ID

#: Ranges found in the first step, and by each query of the second.
COARSE = 256
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Cuts:
    """Upper ends of all ranges but the last, ascending: (doc_id, hash)."""

    ids: np.ndarray
    hashes: np.ndarray

    def part(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range of each row: how many cuts lie below it."""
        first, last = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        out = first.astype(np.int64)
        on = np.flatnonzero(last > first)
        for a in np.unique(first[on]).tolist():
            rows = on[first[on] == a]
            out[rows] = a + np.searchsorted(self.hashes[a : last[rows[0]]], hashes[rows], "left")
        return out


def _quantiles(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def cuts(rows: DataFrame, size: int, per_range: int) -> Cuts:
    """For ``rows`` (doc_id long, not null; text), of ``size`` bytes in all, ranges of
    about ``per_range`` bytes each."""
    n = max(1, -(-size // per_range))
    if n == 1:
        return Cuts(np.zeros(0, np.int64), np.zeros(0, np.int64))
    coarse = min(n, COARSE)
    found = rows.agg(F.percentile_approx("doc_id", _quantiles(coarse), 10 * coarse).alias("q")).first()["q"]
    ends = np.unique(np.array(found or [], np.int64))
    fine = -(-n // coarse)
    if fine > 1:

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(ends, b.column("doc_id").to_numpy(), "left"), pa.int64()), b.column("doc_id")], ["part", "doc_id"])

        parts = rows.select("doc_id").mapInArrow(within, "part long, doc_id long").groupBy("part")
        q = parts.agg(F.percentile_approx("doc_id", _quantiles(fine), 10 * fine).alias("q")).select(F.explode("q").alias("end")).toArrow()
        ends = np.unique(np.concatenate([ends, q.column("end").to_numpy()]))
    bytes_of = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"))
    hot = bytes_of.where(F.col("bytes") + 16 * F.col("rows") > 2 * per_range).toArrow()  # at most one for two ranges
    ids, hashes = [ends], [np.full(len(ends), _HIGH)]
    for i, b in zip(hot.column("doc_id").to_pylist(), hot.column("bytes").to_pylist()):
        k = max(2, -(-int(b or 0) // per_range))
        ids.append(np.full(k, i))
        hashes.append(np.array([_LOW + (j << 64) // k for j in range(1, k)] + [_HIGH], np.int64))
    ids, hashes = np.concatenate(ids).astype(np.int64), np.concatenate(hashes).astype(np.int64)
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    return Cuts(ids[keep], hashes[keep])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash) without nulls: null text is empty, a null doc_id the
    greatest."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
