"""Substring dedup: words in windows that an earlier document already has.

Method: count-min prefilter. Every unit of documents sketches its windows of
``width`` words; the merged sketch (sharded, see ``sketch``) overestimates counts,
so windows estimated once are certainly unrepeated. A second pass over the text
groups only the windows estimated repeated, exactly (96 hash bits from two
independent families), and finds which occur in a document with a smaller id.
A third pass removes the words those windows cover.

The text itself is never shuffled: units and shards exchange packed integers, in
hops of linear traffic (``exchange``), and each pass reads the documents where they lie.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import exchange as X
from . import sketch as S
from . import textkit as T
from .textkit import U64

WIDTH = 13
DEPTH = 2


class _Words:
    """Words and windows of one block. Kept between the passes over a unit's blocks,
    so spans are 32-bit and what follows from them is computed where it is used."""

    def __init__(self, table: pa.Table, width: int):
        self.table, self.width = table, width
        self.buf, off = T.buffers(table.column("text"))
        starts, ends, self.woff = T.word_spans(self.buf, off)
        every = T.window_hashes(T.word_hashes(self.buf, starts, ends), width)
        first = T.windows_in(self.woff, width)[0]
        self.h = every[first] if len(first) else np.zeros(0, np.uint64)
        kind = np.int32 if len(self.buf) < 1 << 31 else np.int64
        self.starts, self.ends = starts.astype(kind), ends.astype(kind)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return T.windows_in(self.woff, self.width)

    def second(self, at: np.ndarray) -> np.ndarray:
        """32 bits of an independent hash of the windows that begin at the words ``at``."""
        words = T.word_hashes(self.buf, self.starts.astype(np.int64), self.ends.astype(np.int64), seed=1)
        odd = T._family(1)[2]
        acc = np.zeros(len(at), np.uint64)
        for j in range(self.width):
            acc += words[at + j] * odd[j % 64] + (U64(j) if j >= 64 else U64(0))
        return T.mix(acc) >> U64(32)


class Least(X.Flags):
    """Entries (hash, second hash, least doc_id); the answer is whether a smaller
    doc_id has the window too."""

    def encode(self, e: X.Entries) -> bytes:
        h, g, doc = e
        least = int(doc.min())
        span = (doc - least).astype(np.uint64)
        size = (max(1, int(span.max()).bit_length()) + 7) // 8 * 8
        docs = np.array([least, size], "<i8").tobytes() + T.pack_bits(span, size)
        return T.joined(T.pack_sorted(h), T.joined(T.pack_bits(g, 32), docs))

    def decode(self, body: bytes, n: int) -> X.Entries:
        h, rest = T.parted(body)
        g, docs = T.parted(rest)
        least, size = (int(v) for v in np.frombuffer(docs, "<i8", 2))
        return T.unpack_sorted(h), T.unpack_bits(g, 32, n), T.unpack_bits(docs[16:], size, n).astype(np.int64) + least

    def merge(self, parts: list[X.Entries]) -> X.Entries:
        return least_of(*(np.concatenate(x) for x in zip(*parts)))[0]

    def final(self, e: X.Entries) -> np.ndarray:
        return np.zeros(len(e[0]), bool)

    def ready(self, merged: X.Entries, answer: np.ndarray) -> X.Entries:
        return *merged, answer

    def back(self, ready: X.Entries, own: X.Entries) -> np.ndarray:
        h, g, doc, answer = ready
        at = np.searchsorted(h, own[0])
        while (wrong := g[at] != own[1]).any():  # two windows of one first hash
            at[wrong] += 1
        return (doc[at] < own[2]) | answer[at]


def least_of(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[X.Entries, np.ndarray]:
    """Distinct windows with their least doc_id, and which of them each one is."""
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return (h[at], g[at], doc[at]), group


class _Candidates:
    """The windows of a unit that are estimated repeated, grouped exactly."""

    def __init__(self, blocks: list[pa.Table], unit: str, place: tuple[str, int], shape: S.Shape, width: int):
        self.blocks = [_Words(t, width) for t in blocks]
        hit = S.repeated(shape, place, unit, np.concatenate([w.h for w in self.blocks]))
        at = np.cumsum([0, *(len(w.h) for w in self.blocks)])
        #: Per block the first words of its candidates, and their documents' ids.
        self.first, self.doc, h, g = [], [], [], []
        for w, a, b in zip(self.blocks, at.tolist(), at[1:].tolist()):
            which = np.flatnonzero(hit[a:b])
            first, row = w.windows()
            self.first.append(first[which])
            self.doc.append(S.ids_of(w.table)[row[which]])
            h.append(w.h[which])
            g.append(w.second(self.first[-1]) if len(which) else np.zeros(0, np.uint64))
            w.h = None
        self.entries, self.group = least_of(np.concatenate(h), np.concatenate(g), np.concatenate(self.doc))

    def gone(self, smaller: np.ndarray) -> Iterator[tuple[_Words, np.ndarray]]:
        """Per block, which words lie in a window that an earlier document has;
        ``smaller`` says which of the entries one outside of this unit has."""
        hit = smaller[self.group] | (self.entries[2][self.group] < np.concatenate(self.doc)) if len(self.group) else np.zeros(0, bool)
        at = 0
        for w, first in zip(self.blocks, self.first):
            begin = first[hit[at : at + len(first)]]
            at += len(first)
            n = len(w.starts)
            step = np.bincount(begin, minlength=n + 1) - np.bincount(begin + w.width, minlength=n + 1)
            yield w, np.cumsum(step[:n]) > 0


class _Passes:
    """Sketch and exact grouping of a table; then its blocks with the words to go."""

    def __init__(self, docs: DataFrame, width: int):
        X.pin_splits(docs)
        size = S.total_bytes(docs)
        self.width = width
        self.shape = shape = S.Shape.of(size // 6, DEPTH)
        self.first = first = S.estimate(docs, shape, lambda t: _Words(t, width).h, size, "windows-estimated")
        # candidates are fewer than windows, so shards of the same number hold less
        self.cut = cut = min(shape.cut, shape.first)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from X.messages(Least(), ((unit, _Candidates(blocks, unit, first, shape, width).entries) for unit, blocks in X.units(batches)), 64 - cut)

        self.second = X.file_replies(docs.mapInArrow(send, X.SENT), Least(), 64, cut, shape.cut, shape.fan, size, "windows-exact")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, np.ndarray]]:
        for unit, blocks in X.units(batches):
            c = _Candidates(blocks, unit, self.first, self.shape, self.width)
            yield from c.gone(X.answers_of(self.second, unit, Least(), c.entries, 64 - self.cut))


def _kept(texts: list[bytes], woff: np.ndarray, gone: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for raw, a, b in zip(texts, woff.tolist(), woff[1:].tolist()):
        n = int(gone[a:b].sum())
        words = raw.split()
        yield n, b" ".join(itertools.compress(words, (~gone[a:b]).tolist()) if n else words)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with every word removed that lies in a window of ``width`` words
    also starting in a document with a smaller doc_id; kept words are joined by
    one space. Adds n_words and n_removed, each with underscores before it until no
    column of ``docs`` has that name.

    ``docs`` must give the same rows in the same order each time it is read: a
    table, not a shuffle (else write it first; a change is noticed and raised).
    Null text has no words and stays null; a null doc_id counts as the greatest;
    rows of one doc_id never remove each other's words. Texts without a removed
    word come back unchanged, byte for byte. Other columns pass through."""
    T.bounded_batches(docs.sparkSession)
    from pyspark.sql.types import LongType, StructField, StructType

    fields = docs.schema.fields
    taken = {f.name.lower() for f in fields}
    n_words, n_removed = (next(n for n in itertools.accumulate(itertools.repeat("_"), lambda a, u: u + a, initial=name) if n not in taken) for name in ("n_words", "n_removed"))

    passes = _Passes(docs.select("doc_id", "text"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, gone in passes(batches):
            t = w.table
            col = t.column("text").combine_chunks()
            kept = list(_kept(T.raw_texts(col), w.woff, gone))
            old = col.to_pylist()
            text = [x if not n else k.decode() for x, (n, k) in zip(old, kept)]
            t = t.set_column(t.column_names.index("text"), "text", pa.array(text, pa.string()))
            t = t.append_column(n_words, pa.array(np.diff(w.woff), pa.int64())).append_column(n_removed, pa.array([n for n, _ in kept], pa.int64()))
            yield from t.to_batches()

    return docs.mapInArrow(run, StructType([*fields, StructField(n_words, LongType()), StructField(n_removed, LongType())]))


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one
    space, of every document; see ``dedup``."""
    T.bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    passes = _Passes(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, gone in passes(batches):
            t = w.table
            kept = [(n, hashlib.sha256(k).hexdigest()) for n, k in _kept(T.raw_texts(t.column("text")), w.woff, gone)]
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(np.diff(w.woff), pa.int64()), pa.array([n for n, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(T.table(spark, sf_dir, "documents"))


# Words by regexp; windows as joined words (a word holds no space, so the joined
# text is the word sequence); the least doc_id per window; covered positions.
OP8_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM k),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM f WHERE least < doc_id GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
         ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""
