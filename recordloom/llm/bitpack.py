"""Token-ID files: every id in the fewest bits the vocabulary needs.

A file holds documents in order. Layout, little-endian:

    magic "RLBP0001", then int64: bits per id, ids per block, documents, ids, blocks
    documents x (int64 doc_id, int64 ids before it in the file)
    (blocks + 1) x int64 byte offsets of the blocks within the payload
    payload: blocks, each padded to a whole byte, ids most significant bit first

Any run of ids is read by unpacking only the blocks it touches, with numpy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges as R
from . import sketch as S
from . import textkit as T
from . import tokens as K

MAGIC = b"RLBP0001"
BLOCK = 8192
END_ID = 2
#: Bytes of text that one file's documents have, on average.
FILE_BYTES = 32 << 20
#: A file has at most so many ids, unless one document has more.
FILE_IDS = 12 << 20


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def write_file(sink, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> None:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    n = -(-len(ids) // block)
    full = (block * bits + 7) // 8
    offsets = np.arange(n + 1, dtype=np.int64) * full
    if n:
        offsets[n] = offsets[n - 1] + ((len(ids) - (n - 1) * block) * bits + 7) // 8
    sink.write(MAGIC + np.array([bits, block, len(docs), len(ids), n], "<i8").tobytes())
    before = np.cumsum(sizes) - sizes
    sink.write(np.column_stack([docs, before]).astype("<i8").tobytes())
    sink.write(offsets.astype("<i8").tobytes())
    step = block * max(1, (1 << 20) // block)
    if (block * bits) % 8 == 0:
        for i in range(0, len(ids), step):
            sink.write(T.pack_bits(ids[i : i + step], bits))
    else:
        for i in range(0, len(ids), block):
            sink.write(T.pack_bits(ids[i : i + block], bits))


class PackedFile:
    """Random access to a file; ``source`` is a seekable pyarrow or Python file."""

    def __init__(self, source):
        self.source = source
        head = source.read(48)
        if head[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.bits, self.block, self.n_docs, self.n_ids, self.n_blocks = (int(x) for x in np.frombuffer(head, "<i8", 5, 8))
        table = np.frombuffer(source.read(16 * self.n_docs), "<i8").reshape(-1, 2)
        self.docs, self.starts = table[:, 0], np.append(table[:, 1], self.n_ids)
        self.offsets = np.frombuffer(source.read(8 * (self.n_blocks + 1)), "<i8")
        self.payload = 48 + 16 * self.n_docs + 8 * (self.n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids ``start`` to ``stop`` of the file, from the blocks they lie in."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError("outside the file")
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(self.payload + int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        if (self.block * self.bits) % 8 == 0:
            out = T.unpack_bits(raw, self.bits, min(self.n_ids, (last + 1) * self.block) - first * self.block)
        else:
            base = self.offsets[first]
            out = np.concatenate([T.unpack_bits(raw[self.offsets[b] - base : self.offsets[b + 1] - base], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)])
        return out[start - first * self.block : stop - first * self.block].astype(np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _encoded(file: str, end_id: int, cuts: R.Cuts, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.library_encoder(file)
        for t in T.blocks(batches):
            ids, off = encoder.ids(t.column("text"))
            docs = S.ids_of(t)
            packed = [T.pack_bits(np.append(ids[a:b], np.uint32(end_id)), bits) for a, b in zip(off.tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cuts.part(docs, t.column("text_hash").to_numpy()), pa.int64()), pa.array(docs, pa.int64()), pa.array(np.diff(off) + 1, pa.int64()), pa.array(packed, pa.binary())],
                ["part", "doc_id", "n", "packed"],
            )

    return run


def _name(part: int, number: int) -> str:
    return f"part-{part:09d}-{number:05d}.ids"


def _write(root: str, bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = T.filesystem(root)
        system.create_dir(base, recursive=True)
        part, number, held, docs, sizes, packed = None, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate([T.unpack_bits(p, bits, n).astype(np.uint32) for p, n in zip(packed, sizes)])
            draft, final = f"{base}/.{uuid.uuid4().hex}", f"{base}/{_name(part, number)}"
            with system.open_output_stream(draft) as sink:
                write_file(sink, np.array(docs, np.int64), np.array(sizes, np.int64), ids, bits)
            system.move(draft, final)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, number, len(docs), len(ids))], ["part", "number", "n_docs", "n_ids"])

        for batch in batches:
            for p, d, n, x in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "packed"))):
                if docs and (p != part or held + n > most):
                    yield close()
                    number, held, docs, sizes, packed = (number + 1 if p == part else 0), 0, [], [], []
                part = p
                docs.append(d)
                sizes.append(n)
                packed.append(x)
                held += n
        if docs:
            yield close()

    return run


def write(docs: DataFrame, root: str, file: str, end_id: int = END_ID) -> DataFrame:
    """Encodes every text of ``docs`` (null: empty), appends ``end_id``, and writes
    files of ascending doc_id under ``root``, each of at most FILE_IDS ids (more only
    if one document has more). Returns the files: part, number (within the part),
    n_docs, n_ids, and start, the ids in all files before. A null doc_id counts as the
    greatest; rows of one doc_id lie side by side. No rows give no files.

    A part is a range of about FILE_BYTES of text (see ``ranges``), however the ids
    are spread and however many rows one id has; only packed ids are shuffled."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    T.bounded_batches(spark)
    docs = R.keyed(docs)
    bits = width_of(max(Tokenizer.from_file(file).get_vocab_size(), end_id + 1))
    cuts = R.cuts(docs, S.total_bytes(docs), FILE_BYTES)
    rows = docs.mapInArrow(_encoded(file, end_id, cuts, bits), "part long, doc_id long, n long, packed binary")
    done = rows.repartition("part").sortWithinPartitions("part", "doc_id", "n", "packed").mapInArrow(_write(root, bits, FILE_IDS), "part long, number long, n_docs long, n_ids long")
    done = T.written(done, "id-files")
    before = F.sum("n_ids").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    return done.withColumn("start", F.coalesce(before, F.lit(0)))


def _digests(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = T.filesystem(root)
        for batch in batches:
            for part, number, start in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "start"))):
                with system.open_input_file(f"{base}/{_name(part, number)}") as source:
                    f = PackedFile(source)
                    step = 64 * f.block
                    crc = np.empty(f.n_docs, np.int64)
                    for d in range(f.n_docs):  # many short documents share a read
                        a, b = int(f.starts[d]), int(f.starts[d + 1])
                        if d == 0 or b > held_to:
                            held_from, held_to = a, max(b, min(f.n_ids, a + step))
                            held = f.ids(held_from, held_to).astype("<u4")
                        crc[d] = zlib.crc32(held[a - held_from : b - held_from])
                    ids = pa.array(f.docs, pa.int64(), mask=f.docs == S.MAX_ID)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(f.starts[:-1] + start, pa.int64()), pa.array(np.diff(f.starts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def digest(files: DataFrame, root: str) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens and the CRC-32 of the ids."""
    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "part", "number")
    return spread.mapInArrow(_digests(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = T.fresh_dir(spark, "token-ids")
    return digest(write(T.table(spark, sf_dir, "documents"), root, K.path("byte_bpe_50k.json")), root)
