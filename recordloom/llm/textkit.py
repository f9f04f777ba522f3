"""Shared plumbing of the corpus operators: Arrow text buffers as numpy arrays,
vectorised word spans and hashes, and compact sorted-integer blobs.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D`` (UTF-8
never uses those bytes inside a longer sequence). Everything here works on whole
texts: long texts are hashed piecewise at word ends, never cut.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import fresh_dir, remove, scope, shared_dir, written  # noqa: F401

#: Texts are gathered into blocks of about so many bytes before numpy sees them.
BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WORD = ~_SPACE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_wide(df: DataFrame, at: str) -> DataFrame:
    """A table of few but wide rows (megabytes each), in row groups of bounded size."""
    df.write.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "4").option("parquet.block.size", str(32 << 20)).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives memory that blocks have freed back to the system: a worker lives long,
    and what its allocators keep would count against the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


# text buffers


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    base, end = int(off[0]), int(off[-1])
    buf = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return buf, off - base


def raw_texts(col) -> list[bytes]:
    buf, off = buffers(col)
    whole, at = buf.tobytes(), off.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Rows gathered into tables of about ``limit`` text bytes, in order. The cut
    depends on the rows alone, so a second pass over the same rows cuts alike."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        total = np.cumsum(lens)
        done = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(total, done + limit - size, "left")) + 1
            if stop > batch.num_rows:
                held.append(batch.slice(start))
                size += int(total[-1]) - done
                break
            held.append(batch.slice(start, stop - start))
            yield pa.Table.from_batches(held)
            release()
            held, size, done, start = [], 0, int(total[stop - 1]), stop
    if held:
        yield pa.Table.from_batches(held)
        release()


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = _WORD[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """r^i and r^-i modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inv, k, 1 << 64))])
        return self.up, self.down


@functools.cache
def _family(seed: int) -> tuple[np.ndarray, _Powers, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(0x5EED + seed))
    values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    odd = rng.integers(0, 1 << 63, 65, dtype=np.uint64) * U64(2) + U64(1)
    return values, _Powers(int(odd[0])), odd[1:]


#: Bytes hashed at a time: what is computed of them fits the processor's cache.
_STEP = 1 << 15


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes and length alone."""
    values, powers, _ = _family(seed)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _STEP, "right")))
        b = int(ends[j - 1])
        if b - a > _STEP:  # one word longer than a step: summed piece by piece
            up, _ = powers.upto(_STEP)
            total = 0
            for x in range(a, b, _STEP):
                part = values[buf[x : min(b, x + _STEP)]]
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(powers.base, x - a, 1 << 64)
            out[i:j] = mix(np.array([(total + b - a) & ((1 << 64) - 1)], np.uint64))
            i = j
            continue
        up, down = powers.upto(b - a + 1)
        acc = np.empty(b - a + 1, np.uint64)
        acc[0] = 0
        np.cumsum(values[buf[a:b]] * up[: b - a], out=acc[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` words (those across rows included; see windows_in)."""
    odd = _family(seed)[2]
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n] * odd[0]
    for j in range(1, k):
        acc += words[j : j + n] * odd[j % 64] if j < 64 else mix(words[j : j + n] + U64(j))
    return mix(acc)


def windows_in(woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window that lies within one row, and its row."""
    per = np.maximum(np.diff(woff) - k + 1, 0)
    row = np.repeat(np.arange(len(per)), per)
    first = np.cumsum(per) - per
    return np.arange(len(row)) - first[row] + woff[:-1][row], row


def unit_hash(texts: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts], np.uint64)


# sorted integers as blobs


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending integers in quasi-minimal space: low bits side by side, high bits
    in unary (Elias-Fano). About 2 + log2(range / count) bits each."""
    n = len(v)
    if not n:
        return b""
    v = v.astype(np.uint64)
    base = v[0]
    v = v - base
    low = max(0, int(np.log2(max(1.0, float(v[-1]) / n))))
    high = (v >> U64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, np.uint8)
    marks[high] = 1
    head = np.array([n, low, int(base)], np.uint64).tobytes()
    return head + pack_bits((v & U64((1 << low) - 1)), low) + np.packbits(marks).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, low, base = (int(x) for x in np.frombuffer(blob, np.uint64, 3))
    cut = 24 + (n * low + 7) // 8
    lows = unpack_bits(blob[24:cut], low, n)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=cut)))[:n] - np.arange(n)
    return (high.astype(np.uint64) << U64(low)) + lows + U64(base)


def pack_bits(v: np.ndarray, width: int) -> bytes:
    """Each of ``v`` in ``width`` bits, most significant first."""
    if not width or not len(v):
        return b""
    if width in (8, 16, 32):
        return v.astype(f">u{width // 8}").tobytes()
    if width % 8 == 0:
        wide = v.astype(">u8").view(np.uint8).reshape(-1, 8)
        return np.ascontiguousarray(wide[:, 8 - width // 8 :]).tobytes()
    out = np.empty((len(v), width), np.uint8)
    v = v.astype(np.uint64)
    for b in range(width):
        out[:, b] = (v >> U64(width - 1 - b)) & U64(1)
    return np.packbits(out.reshape(-1)).tobytes()


def unpack_bits(blob: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    if width in (8, 16, 32):
        return np.frombuffer(blob, f">u{width // 8}", n).astype(np.uint64)
    if width % 8 == 0:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 8 - width // 8 :] = np.frombuffer(blob, np.uint8, n * width // 8).reshape(n, -1)
        return wide.reshape(-1).view(">u8").astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))[: n * width].reshape(n, width)
    out = np.zeros(n, np.uint64)
    for b in range(width):
        out = (out << U64(1)) | bits[:, b]
    return out


def joined(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(8, "little") + first + second


def parted(body: bytes) -> tuple[bytes, bytes]:
    cut = 8 + int.from_bytes(body[:8], "little")
    return body[8:cut], body[cut:]


@functools.cache
def filesystem(root: str):
    """pyarrow's view of the shared folder, for workers: file system and path."""
    from pyarrow import fs

    if root.startswith("s3a:"):  # pyarrow calls it s3
        root = "s3" + root[3:]
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
