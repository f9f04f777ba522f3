"""Document fingerprints by consistent weighted sampling.

Method: a text is a bag of two-word shingles (ASCII lower-cased), weighted by their
counts. For each of SAMPLES samples and each term with weight S, three fixed draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1) give t = floor(ln S / r + b) and
ln a = ln c - r (t - b) - r; the term with the least a, and its t, are the sample.
Two texts agree in a sample with a probability equal to their generalised Jaccard
similarity. A fingerprint keeps 16 bits of each sample.

Draws are 32-bit hashes (two tables added up) looked up in quantiles of the Gamma
distribution, so they depend on the term alone and the whole evaluation is numpy.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges as R
from . import sketch as S
from . import textkit as T
from .textkit import U64

SAMPLES = 64
SHINGLE = 2
#: Terms evaluated at a time: their samples fit the processor's cache.
STEP = 1024
#: Text bytes of a range of neighbouring doc_ids, on average.
RANGE_BYTES = 24 << 20


@functools.cache
def _draws() -> tuple[np.ndarray, ...]:
    rng = np.random.Generator(np.random.PCG64(20))
    tables = [rng.integers(0, 1 << 32, (1 << 10, SAMPLES), dtype=np.uint32) for _ in range(2)]
    # quantiles of Gamma(2, 1): its distribution function is 1 - (1 + x) exp(-x)
    x = np.geomspace(1e-5, 60, 400_001)
    gamma = np.interp((np.arange(2048) + 0.5) / 2048, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)
    unit = ((np.arange(1024) + 0.5) / 1024).astype(np.float32)
    # 64 keeps the logarithms positive, so that their bits sort as they do
    return (*tables, np.log(gamma) + np.float32(64), gamma, unit)


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (48-bit hashes), their counts, and the term offsets of rows."""
    buf = T.lower_ascii(buf)
    starts, ends, woff = T.word_spans(buf, off)
    words = T.word_hashes(buf, starts, ends)
    first, row = T.windows_in(woff, SHINGLE)
    h = T.window_hashes(words, SHINGLE)[first] if len(first) else np.zeros(0, np.uint64)
    few = np.flatnonzero((np.diff(woff) > 0) & (np.diff(woff) < SHINGLE))
    h, row = np.concatenate([h, T.mix(words[woff[few]])]), np.concatenate([row, few])
    rows = len(off) - 1
    width = max(1, rows.bit_length())
    key = np.sort((row.astype(np.uint64) << U64(64 - width)) | (h >> U64(width)))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    term = (key[new] << U64(width)) >> U64(16)
    return term, np.diff(np.append(new, len(key))), np.searchsorted((key[new] >> U64(64 - width)).astype(np.int64), np.arange(rows + 1))


def fingerprints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit samples of each text; zeros without words."""
    one, two, ln_c, r, b = _draws()
    term, count, toff = _terms(buf, off)
    out = np.zeros((len(off) - 1, SAMPLES), np.uint16)
    least = np.full((len(off) - 1, SAMPLES), np.iinfo(np.uint64).max)
    row = np.repeat(np.arange(len(off) - 1), np.diff(toff))
    mixed = T.mix(term)
    i1, i2 = (mixed & U64(1023)).astype(np.int64), ((mixed >> U64(10)) & U64(1023)).astype(np.int64)
    salt = (mixed >> U64(20)).astype(np.uint32)
    high = (T.mix(mixed) >> U64(32)).astype(np.uint32)  # of t = 0, as a weight of 1 has
    for x in range(0, len(term), STEP):
        y = min(len(term), x + STEP)
        v = one[i1[x:y]]
        v += two[i2[x:y]]
        v ^= salt[x:y, None]
        v *= np.uint32(0x9E3779B1)
        v ^= v >> np.uint32(15)
        base = (b - np.float32(1))[v & np.uint32(1023)]
        rr = r[(v >> np.uint32(10)) & np.uint32(2047)]
        base *= rr
        base += ln_c[v >> np.uint32(21)]
        packed = np.empty((y - x, SAMPLES, 2), np.uint32)
        packed[:, :, 0] = high[x:y, None]
        many = np.flatnonzero(count[x:y] > 1)
        if len(many):
            t = np.floor(np.log(count[x:y][many].astype(np.float32))[:, None] / rr[many] + b[v[many] & np.uint32(1023)])
            base[many] -= rr[many] * t
            packed[many, :, 0] = T.mix(mixed[x:y][many][:, None] + t.astype(np.int64).astype(np.uint64) * U64(0xD6E8FEB86659FD93)) >> U64(32)
        packed[:, :, 1] = base.view(np.uint32)
        at = np.flatnonzero(np.append(True, row[x + 1 : y] != row[x : y - 1]))
        rows = row[x:y][at]
        least[rows] = np.minimum(least[rows], np.minimum.reduceat(packed.view("<u8")[:, :, 0], at, axis=0))
    some = np.diff(toff) > 0
    out[some] = (T.mix(least[some] & U64(0xFFFFFFFF)) >> U64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples in which fingerprints agree: estimates generalised Jaccard."""
    return (a == b).mean(1)


def _hex(prints: np.ndarray) -> list[str]:
    whole, n = prints.astype(">u2").tobytes().hex(), SAMPLES * 4
    return [whole[i : i + n] for i in range(0, len(whole), n)]


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null text is empty."""
    T.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in T.blocks(batches):
            yield pa.RecordBatch.from_arrays([t.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(_hex(fingerprints(*T.buffers(t.column("text")))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, helper, doc_id, text_hash, text) such that, sorted by part, helper,
    and descending doc_id (then text_hash, text), every row that isn't a helper is
    followed by its next document; the last one's next is the first. One shuffle of
    the text, into ranges (see ``ranges``); the greatest document of a range goes to
    the next range up as well, as a helper. A null doc_id counts as the greatest."""
    docs = R.keyed(docs)
    cuts = R.cuts(docs, S.total_bytes(docs), RANGE_BYTES)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = cuts.part(b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), b.column("doc_id"), b.column("text_hash")], ["part", "doc_id", "text_hash"])

    placed = docs.select("doc_id", "text_hash").mapInArrow(ranges, "part long, doc_id long, text_hash long")
    # one row a range
    tops = placed.groupBy("part").agg(F.max(F.struct("doc_id", "text_hash")).alias("top")).select("part", "top.*").toArrow().sort_by("part")
    part, top_id, top_hash = (tops.column(c).to_numpy() for c in ("part", "doc_id", "text_hash"))
    above = np.roll(part, -1)  # the next range up that has rows; the lowest for the highest

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()  # one of several rows that are the same will do
        for b in batches:
            ids, hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
            own = cuts.part(ids, hashes)
            at = np.searchsorted(part, own)
            extra = []
            for i in np.flatnonzero((top_id[at] == ids) & (top_hash[at] == hashes)).tolist():
                if int(own[i]) not in sent:
                    sent.add(int(own[i]))
                    extra.append(i)
            take = pa.array([*range(len(ids)), *extra], pa.int64())
            to = np.concatenate([own, above[at[np.array(extra, np.int64)]]])
            helper = np.repeat(np.array([0, 1], np.int32), [len(ids), len(extra)])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(helper), *(b.column(c).take(take) for c in ("doc_id", "text_hash", "text"))], ["part", "helper", "doc_id", "text_hash", "text"])

    return docs.mapInArrow(place, "part long, helper int, doc_id long, text_hash long, text string").repartition("part").sortWithinPartitions("part", "helper", F.desc("doc_id"), F.desc("text_hash"), F.desc("text"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carry: pa.Table | None = None
    for t in T.blocks(batches):
        if carry is not None:
            t = pa.concat_tables([carry, t])
        buf, off = T.buffers(t.column("text"))
        part, helper = t.column("part").to_numpy(), t.column("helper").to_numpy()
        carry = t.slice(t.num_rows - 1) if not helper[-1] else None
        at = np.flatnonzero((helper[:-1] == 0) & (part[1:] == part[:-1]))
        prints = fingerprints(buf, off)
        raw = buf.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(off.tolist(), off[1:].tolist())]
        edited = []
        for i in at.tolist():
            half = len(texts[i]) // 2
            edited.append((texts[i][: len(texts[i]) - half] + texts[i + 1][:half]).encode())
        other = fingerprints(*_buffer(edited))
        ids = t.column("doc_id").to_numpy()[at]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=ids == S.MAX_ID),
                pa.array([len(texts[i]) for i in at.tolist()], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(_hex(prints[at]), pa.string()),
                pa.array(_hex(other), pa.string()),
                pa.array(likeness(prints[at], other), pa.float64()),
                pa.array(likeness(prints[at], prints[at + 1]), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.bounded_batches(spark)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(T.table(spark, sf_dir, "documents")).mapInArrow(_compared, schema)
