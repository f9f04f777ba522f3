"""Which hashes of a corpus occur more than once: a count-min sketch in shards.

A dense sketch wide enough for a large corpus fits no task and no broadcast, so
each unit of documents sends its own sketch sparsely: the ascending cells it touched
(two bits and the logarithm of their mean distance each, see ``pack_sorted``) and one
bit for cells it touched at least twice. Cells are ranges, ranges are shards; a shard
adds up the units and answers each with one bit per cell it sent: estimated count of
two or more, or not (see ``exchange``). A cell that two equal hashes share always
counts two, so nothing repeated is ever missed; unlike hashes in one cell only cause
extra candidates.

The width follows the number of hashes in the corpus, so that the share of false
candidates is the same at every size. A hot hash is one cell per unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkit as T
from .exchange import MAX_ID, ids_of  # noqa: F401
from .textkit import U64

_ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)]

#: Entries a shard gets, on average.
SHARD_ENTRIES = 3_000_000


@dataclass(frozen=True)
class Shape:
    """``depth`` rows of 2^``bits`` cells. A key is a row's number and a cell; all
    rows together are cut into 2^``cut`` shards."""

    bits: int
    depth: int
    cut: int
    fan: int

    @staticmethod
    def of(total: int, depth: int, per_hash: int = 4) -> Shape:
        total = max(total, 1 << 12)
        bits = int(np.ceil(np.log2(total * per_hash)))
        return Shape(bits, depth, max(3, int(np.ceil(np.log2(depth * total / SHARD_ENTRIES)))), X.FAN)

    @property
    def width(self) -> int:
        return self.bits + (self.depth - 1).bit_length()

    @property
    def first(self) -> int:
        """Bits by which units cut their messages."""
        return min(self.cut, self.fan)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return ((h * _ODD[row]) >> U64(64 - self.bits)) + (U64(row) << U64(self.bits))

    def entries(self, h: np.ndarray) -> X.Entries:
        found = [distinct(np.sort(self.cells(h, r))) for r in range(self.depth)]
        return np.concatenate([c for c, _ in found]), np.concatenate([many for _, many in found])


class Sketch(X.Flags):
    """Entries (cell, whether it was touched twice); the answer is whether it was by
    all units together."""

    def encode(self, e: X.Entries) -> bytes:
        return T.joined(T.pack_sorted(e[0]), np.packbits(e[1]).tobytes())

    def decode(self, body: bytes, n: int) -> X.Entries:
        cells, twice = T.parted(body)
        return T.unpack_sorted(cells), np.unpackbits(np.frombuffer(twice, np.uint8))[:n].astype(bool)

    def merge(self, parts: list[X.Entries]) -> X.Entries:
        # the flag below the cell, so that a plain sort puts a cell's flagged entry last
        every = np.sort(np.concatenate([(cell << U64(1)) | twice.astype(np.uint64) for cell, twice in parts]))
        cell = every >> U64(1)
        last = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
        return cell[last], (np.diff(last, prepend=-1) > 1) | ((every[last] & U64(1)) == 1)

    def final(self, e: X.Entries) -> np.ndarray:
        return e[1]

    def ready(self, merged: X.Entries, answer: np.ndarray) -> X.Entries:
        return (merged[0][answer],)

    def back(self, ready: X.Entries, own: X.Entries) -> np.ndarray:
        hot = ready[0]
        return hot[np.minimum(np.searchsorted(hot, own[0]), len(hot) - 1)] == own[0] if len(hot) else np.zeros(len(own[0]), bool)


_SIEVE = U64((1 << 22) - 1)


def within(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among ascending ``values``; a table of their last bits,
    small enough for the processor's cache, answers no for most of those that aren't."""
    out = np.zeros(len(asked), bool)
    if len(values):
        sieve = np.zeros(1 << 22, bool)
        sieve[values & _SIEVE] = True
        maybe = np.flatnonzero(sieve[asked & _SIEVE])
        own = asked[maybe]
        out[maybe[values[np.minimum(np.searchsorted(values, own), len(values) - 1)] == own]] = True
    return out


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def distinct(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of ascending values, and which of them occur twice or more."""
    if not len(sorted_values):
        return sorted_values, np.zeros(0, bool)
    first = np.ones(len(sorted_values), bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    at = np.flatnonzero(first)
    return sorted_values[at], np.diff(np.append(at, len(sorted_values))) > 1


def estimate(docs: DataFrame, shape: Shape, hashes: Callable[[pa.Table], np.ndarray], size: int, what: str) -> tuple[str, int]:
    """Sketches ``docs`` (doc_id, text); returns where ``repeated`` finds the answers."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from X.messages(Sketch(), ((unit, shape.entries(np.concatenate([hashes(t) for t in blocks]))) for unit, blocks in X.units(batches)), shape.width - shape.first)

    return X.file_replies(docs.mapInArrow(send, X.SENT), Sketch(), shape.width, shape.first, shape.cut, shape.fan, size, what)


def repeated(shape: Shape, place: tuple[str, int], unit: str, h: np.ndarray) -> np.ndarray:
    """Which of ``h``, all the hashes of a unit, may occur twice or more in the corpus:
    their least estimate over the rows is at least two."""
    e = shape.entries(h)
    heavy = e[0][X.answers_of(place, unit, Sketch(), e, shape.width - shape.first)]
    out = np.arange(len(h))
    for r in range(shape.depth):
        out = out[within(heavy, shape.cells(h[out], r))]
    found = np.zeros(len(h), bool)
    found[out] = True
    return found
