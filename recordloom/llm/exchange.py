"""Answers from shards of a key space to units of documents, in linear traffic.

A unit (some megabytes of text, or of sets) has a sorted list of distinct keys, each
with a value; a shard of the key space adds up what all units say about a key and
answers every unit. Cutting a unit's keys into as many messages as a large corpus has
shards would leave a key or two in each, and a message costs more than a key. So
keys travel in hops: a hop cuts by at most ``FAN`` further bits of the key; messages
of one group are gathered into batches, a batch is a unit of the next hop, and
answers go back through the batches. A hop's messages stay large however large the
corpus is, every key travels once a hop, and hops grow with the logarithm of the
number of shards. Each hop's batches are a table in the shared folder, removed once
the answers are there.

Answers to documents lie in files with an index (unit to bytes), a bounded number of
them, so that a second pass reads the text where it lies.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import textkit as T
from .textkit import U64

#: Bits of the key by which one hop cuts.
FAN = 12
#: Bytes of messages in a batch.
BATCH_BYTES = 4 << 20
#: Bytes of text in a unit of documents, and in the blocks that it is processed in.
UNIT_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: Bytes of text whose answers share a file.
FILE_BYTES = 512 << 20
LEAST_FILES = 16

SENT = "unit string, shard long, n long, body binary"
REPLY = "unit string, shard long, bits binary"
BATCH = "unit string, units array<string>, ns array<long>, bodies array<binary>"
_REPLY = pa.schema([("shard", pa.int64()), ("bits", pa.binary())])

Entries = tuple[np.ndarray, ...]

MAX_ID = (1 << 63) - 1


class Codec(Protocol):
    """How the values of one key add up. ``Entries`` are arrays, the first the keys,
    ascending and distinct (two arrays may make up a key; the first rules)."""

    def encode(self, e: Entries) -> bytes: ...

    def decode(self, body: bytes, n: int) -> Entries: ...

    def merge(self, parts: list[Entries]) -> Entries: ...

    def final(self, e: Entries) -> np.ndarray:
        """The answer to each entry where all entries of its key have come together."""
        ...

    def ready(self, merged: Entries, answer: np.ndarray) -> Entries:
        """What ``back`` needs of merged entries and their answers."""
        ...

    def back(self, ready: Entries, own: Entries) -> np.ndarray:
        """The answers to ``own``, one of the parts that were merged."""
        ...

    def pack(self, answer: np.ndarray) -> bytes: ...

    def unpack(self, bits: bytes, n: int) -> np.ndarray: ...


class Flags:
    """Answers that are one bit."""

    def pack(self, answer: np.ndarray) -> bytes:
        return np.packbits(answer).tobytes()

    def unpack(self, bits: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)


class Count:
    """How many have a key: entries (key, count); the answer is the sum, at most 2^31 - 1."""

    def encode(self, e: Entries) -> bytes:
        return T.joined(T.pack_sorted(e[0]), e[1].astype("<i4").tobytes())

    def decode(self, body: bytes, n: int) -> Entries:
        keys, counts = T.parted(body)
        return T.unpack_sorted(keys), np.frombuffer(counts, "<i4").astype(np.int64)

    def merge(self, parts: list[Entries]) -> Entries:
        key, count = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[at], np.minimum(np.add.reduceat(count, at), (1 << 31) - 1)

    def final(self, e: Entries) -> np.ndarray:
        return e[1]

    def ready(self, merged: Entries, answer: np.ndarray) -> Entries:
        return merged[0], answer

    def back(self, ready: Entries, own: Entries) -> np.ndarray:
        return ready[1][np.searchsorted(ready[0], own[0])]

    def pack(self, answer: np.ndarray) -> bytes:
        return answer.astype("<i4").tobytes()

    def unpack(self, bits: bytes, n: int) -> np.ndarray:
        return np.frombuffer(bits, "<i4").astype(np.int64)


def edges(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ascending keys that agree but for their last ``shift`` bits, and
    where each begins (and the last ends)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    group = (keys >> U64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return group[at], np.append(at, len(keys))


def messages(codec: Codec, found: Iterator[tuple[str, Entries]], shift: int) -> Iterator[pa.RecordBatch]:
    """Rows of SENT: the entries of each unit, cut by group."""
    for unit, e in found:
        groups, at = edges(e[0], shift)
        bodies = [codec.encode(tuple(x[a:b] for x in e)) for a, b in zip(at.tolist(), at[1:].tolist())]
        rows = pa.RecordBatch.from_arrays([pa.array([unit] * len(groups), pa.string()), pa.array(groups), pa.array(np.diff(at)), pa.array(bodies, pa.binary())], ["unit", "shard", "n", "body"])
        del e, bodies
        yield rows
        T.release()


def _final(codec: Codec) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        parts = [codec.decode(b, n) for b, n in zip(t.column("body").to_pylist(), t.column("n").to_pylist())]
        merged = codec.merge(parts)
        ready = codec.ready(merged, codec.final(merged))
        bits = pa.array([codec.pack(codec.back(ready, p)) for p in parts], pa.binary())
        del parts, merged, ready
        T.release()
        return pa.table({"unit": t.column("unit"), "shard": t.column("shard"), "bits": bits})

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages, sorted by group, into batches of one group each."""
    shard, held, size = None, [], 0

    def close() -> pa.RecordBatch:
        units, ns, bodies = (list(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([f"{shard}-{uuid.uuid4().hex}"]), pa.array([units], pa.list_(pa.string())), pa.array([ns], pa.list_(pa.int64())), pa.array([bodies], pa.list_(pa.binary()))], ["unit", "units", "ns", "bodies"])

    for batch in batches:
        for u, s, n, b in zip(*(batch.column(c).to_pylist() for c in ("unit", "shard", "n", "body"))):
            if held and (s != shard or size > BATCH_BYTES):
                yield close()
                held, size = [], 0
            shard = s
            held.append((u, n, b))
            size += len(b)
    if held:
        yield close()


def _merged(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[Entries], Entries]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            parts = [codec.decode(b, n) for b, n in zip(row["bodies"], row["ns"])]
            yield row, parts, codec.merge(parts)


def resolve(sent: DataFrame, codec: Codec, width: int, done: int, cut: int, fan: int) -> DataFrame:
    """Rows of REPLY to ``sent`` (SENT), whose messages are cut by the first ``done``
    bits of keys of ``width`` bits; shards are cut by the first ``cut``."""
    if done >= cut:
        return sent.groupBy("shard").applyInArrow(_final(codec), REPLY)
    spark = sent.sparkSession
    at = scratch.fresh_dir(spark, "message-batches")
    gathered = sent.repartition("shard").sortWithinPartitions("shard", "unit").mapInArrow(_gathered, BATCH)
    batches = T.written_wide(gathered, at)
    done = min(cut, done + fan)
    shift = width - done

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from messages(codec, ((row["unit"], e) for row, _, e in _merged(codec, rows)), shift)

    def back(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, parts, e in _merged(codec, rows):
            ready = codec.ready(e, collected(codec, e, shift, row["answers"]))
            own = int(row["unit"].partition("-")[0])
            bits = [codec.pack(codec.back(ready, p)) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(row["units"], pa.string()), pa.array([own] * len(parts), pa.int64()), pa.array(bits, pa.binary())], ["unit", "shard", "bits"])

    answers = by_unit(resolve(batches.mapInArrow(send, SENT), codec, width, done, cut, fan))
    return batches.join(answers, "unit").mapInArrow(back, REPLY)


def by_unit(replies: DataFrame) -> DataFrame:
    """(unit, answers): a unit has at most 2^FAN of them for each group it is in."""
    return replies.groupBy("unit").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))


def collected(codec: Codec, e: Entries, shift: int, answers: list[dict]) -> np.ndarray:
    """The answers to all entries of a unit, in their order."""
    groups, at = edges(e[0], shift)
    got = {x["shard"]: x["bits"] for x in answers}
    if len(got) != len(groups):
        raise RuntimeError("answers are missing")
    return np.concatenate([codec.unpack(got[g], b - a) for g, a, b in zip(groups.tolist(), at.tolist(), at[1:].tolist())])


# units of documents


def ids_of(table: pa.Table) -> np.ndarray:
    """doc_id as int64; null counts as the greatest id."""
    return pc.fill_null(table.column("doc_id").cast(pa.int64()), MAX_ID).to_numpy().astype(np.int64)


def pin_splits(df: DataFrame) -> None:
    """Several passes must find the same rows in the same splits. Splits depend on the
    number of cores, which may change between passes, unless their number is set."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[pa.Table]]]:
    """Consecutive documents as (name, blocks); the name is a hash of ids and sizes."""
    held: list[pa.Table] = []
    size, name = 0, hashlib.blake2b(digest_size=12)
    for t in T.blocks(batches, limit=BLOCK_BYTES):
        n = int(pc.sum(pc.binary_length(t.column("text"))).as_py() or 0)
        name.update(ids_of(t).astype("<i8").tobytes() + str(n).encode())
        held.append(t)
        size += n
        if size >= UNIT_BYTES:
            yield name.hexdigest(), held
            held, size, name = [], 0, hashlib.blake2b(digest_size=12)
            T.release()
    if held:
        yield name.hexdigest(), held


def _files(total_bytes: int) -> int:
    return max(LEAST_FILES, total_bytes // FILE_BYTES)


def file_replies(sent: DataFrame, codec: Codec, width: int, done: int, cut: int, fan: int, total_bytes: int, what: str) -> tuple[str, int]:
    """Writes the replies to units into files of the shared folder; returns what
    ``read_replies`` needs to find a unit's."""
    spark = sent.sparkSession
    place = scratch.fresh_dir(spark, what), _files(total_bytes)
    with scratch.scope(spark):
        file_rows(resolve(sent, codec, width, done, cut, fan), place)
    return place


def file_rows(rows: DataFrame, place: tuple[str, int]) -> None:
    """Writes rows of REPLY into indexed files, those of a unit side by side."""
    root, n = place

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = T.filesystem(root)
        system.create_dir(base, recursive=True)
        part, sink, index, draft = None, None, {}, ""

        def close() -> None:
            raw = json.dumps(index).encode()
            sink.write(raw + np.array([len(raw)], "<i8").tobytes())
            sink.close()
            system.move(draft, f"{base}/{part}")

        def put(unit: str, held: list[tuple[int, bytes]]) -> None:
            raw = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _REPLY)], schema=_REPLY).serialize()
            index[unit] = (sink.tell(), raw.size)
            sink.write(raw)

        unit, held = None, []
        for batch in batches:
            for p, u, s, b in zip(*(batch.column(c).to_pylist() for c in ("part", "unit", "shard", "bits"))):
                if u != unit or p != part:
                    if held:
                        put(unit, held)
                    unit, held = u, []
                if p != part:
                    if sink is not None:
                        close()
                    part, index, draft = p, {}, f"{base}/.{uuid.uuid4().hex}"
                    sink = system.open_output_stream(draft)
                held.append((s, b))
        if held:
            put(unit, held)
            close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    placed = rows.withColumn("part", F.pmod(F.crc32(F.col("unit").cast("binary")), F.lit(n)))
    placed.repartition("part").sortWithinPartitions("part", "unit", "shard").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def read_replies(place: tuple[str, int], unit: str) -> list[dict]:
    root, n = place
    system, base = T.filesystem(root)
    at = f"{base}/{zlib.crc32(unit.encode()) % n}"
    from pyarrow import fs

    if system.get_file_info(at).type == fs.FileType.NotFound:
        return []
    with system.open_input_file(at) as f:
        end = f.size()
        f.seek(end - 8)
        length = int(np.frombuffer(f.read(8), "<i8")[0])
        f.seek(end - 8 - length)
        found = json.loads(f.read(length)).get(unit)
        if found is None:
            return []
        f.seek(found[0])
        return pa.ipc.read_record_batch(pa.py_buffer(f.read(found[1])), _REPLY).to_pylist()


def answers_of(place: tuple[str, int], unit: str, codec: Codec, e: Entries, shift: int) -> np.ndarray:
    """The answers to a unit's entries, which must be those it sent."""
    got = read_replies(place, unit) if len(e[0]) else []
    groups, at = edges(e[0], shift)
    if {x["shard"] for x in got} != set(groups.tolist()):
        raise RuntimeError(f"documents have changed between two passes (unit {unit}); write them to a table first")
    if not len(e[0]):
        return np.zeros(0, bool)
    return collected(codec, e, shift, got)
