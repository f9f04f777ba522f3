"""Lexical retrieval packing: training windows filled with related documents.

Method: documents are routed to shards by their most telling terms, so that related
ones meet; each shard holds a BM25 inverted index of its documents. A seed document
opens a window; the index returns the shard's unused documents that score best for
all of the seed's distinct terms, and they fill the window greedily. A document
that doesn't fit is cut, and its rest is the next seed. Terms are token ids, so
their document counts, taken over the whole corpus, are a table no larger than the
vocabulary.

Documents are routed by a consistent sample of their terms, weighted by idf: to the
bucket of the first term drawn; where that bucket has more than a shard's worth, to
that of the first two, and so on up to LEVELS. So texts that are alike stay together
however common their terms are. Buckets in order fill shards of about
``shard_tokens`` ids; one that is still too large is split over several, so no shard
grows with the corpus. Only packed ids are shuffled, once.

Windows are full, so nothing is padded: what a shard has left at the end is cut
into sequences of powers of two.

A seed's neighbours come from its own shard. ``search`` finds the best of all
documents for a stated set of seeds, exactly, at the cost of their product.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sketch as S
from . import textkit as T
from . import tokens as K
from .bitpack import END_ID, width_of
from .textkit import U64

WINDOW = 4096
SHARD_TOKENS = 2_000_000
#: A term that more than one in DENSE of a shard's documents have is kept as a row of weights.
DENSE = 8
K1, B = 1.2, 0.75
#: Bytes of weights added up at a time.
HELD = 1 << 19
#: Terms a document is routed by, at most, and bits of a bucket's number.
LEVELS = 4
BUCKETS = 20
_RANGE = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(file: str, end_id: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.library_encoder(file)
        for t in T.blocks(batches):
            ids, off = encoder.ids(t.column("text"))
            packed = [T.pack_bits(np.append(ids[a:b], np.uint32(end_id)), bits) for a, b in zip(off.tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(S.ids_of(t), pa.int64()), pa.array(np.diff(off) + 1, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "packed"])

    return run


def _unpacked(batch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of a batch's documents in a row, and their offsets."""
    n = batch.column("n").to_numpy()
    packed = batch.column("packed").to_pylist()
    if bits % 8 == 0:  # every document ends with a byte, so all are unpacked at once
        ids = T.unpack_bits(b"".join(packed), bits, int(n.sum()))
    else:
        ids = np.concatenate([T.unpack_bits(p, bits, k) for p, k in zip(packed, n.tolist())]) if packed else np.zeros(0, np.uint64)
    return ids, np.concatenate([[0], np.cumsum(n)])


def _terms(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of each distinct term of each document, in order."""
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    key = np.sort((doc << U64(32)) | ids)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[new] >> U64(32)).astype(np.int64), (key[new] & U64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(new, len(key)))


def _counts(bits: int):
    """Document counts of a task's terms, by range of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            _, term, _ = _terms(*_unpacked(batch, bits))
            total += np.bincount(term, minlength=len(total))
        at = [i for i in range(0, len(total), _RANGE) if total[i : i + _RANGE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[i : i + _RANGE].tobytes() for i in at], pa.binary())], ["first", "counts"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()]
    return pa.table({"first": t.column("first").slice(0, 1), "counts": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})


def _keys(idf: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """LEVELS terms of each document, drawn consistently with probability by squared
    idf; the last one again where a document has no more."""
    doc, term, _ = _terms(ids, off)
    u = (T.mix(np.arange(1, len(idf) + 1, dtype=np.uint64)) >> U64(11)).astype(np.float64) / (1 << 53)
    cost = (-np.log(np.maximum(u, 1e-300)) / np.maximum(idf, 1e-6) ** 2).astype(np.float32)
    # positive floats sort as their bits do, so cost and term are one integer
    ranked = ((cost.view(np.uint32).astype(np.uint64) << U64(32)) | np.arange(len(idf), dtype=np.uint64))[term]
    at = np.searchsorted(doc, np.arange(len(off) - 1))  # every document has its end id
    none, out = np.iinfo(np.uint64).max, []
    for level in range(LEVELS):
        least = np.minimum.reduceat(ranked, at)
        out.append(np.where(least == none, out[-1], least & U64(0xFFFFFFFF)) if level else least & U64(0xFFFFFFFF))
        ranked = np.where(ranked == least[doc], none, ranked)
    return np.column_stack(out)


@dataclass
class Routes:
    """From the terms drawn to shards: per level the buckets too large for it, and of
    the buckets that are left the first shard and the number of shards."""

    hot: list[np.ndarray]
    start: np.ndarray
    parts: np.ndarray

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        h = T.mix(keys[:, 0] + U64(1))
        out = (h >> U64(64 - BUCKETS)).astype(np.int64)
        for level, hot in enumerate(self.hot, 1):
            deeper = hot[out]
            h = T.mix(h + (keys[:, level] + U64(1)) * U64(0x9E3779B97F4A7C15))
            out = np.where(deeper, (h >> U64(64 - BUCKETS)).astype(np.int64), out)
            h = np.where(deeper, h, T.mix(h * U64(3)))
        return out

    def shard(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        b = self.bucket(keys)
        return self.start[b] + (T.mix(salt.astype(np.uint64)) % self.parts[b].astype(np.uint64)).astype(np.int64)


_DRAWN = ", ".join(f"k{i} long" for i in range(LEVELS)) + ", n long"


def _drawn(idf, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(idf.value, *_unpacked(batch, bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys.T), batch.column("n")], [*(f"k{i}" for i in range(LEVELS)), "n"])
        T.release()

    return run


def _routes(drawn: DataFrame, shard_tokens: int) -> Routes:
    """The driver holds one figure a bucket, 2^BUCKETS at most."""
    routes = Routes([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    while True:

        def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = np.column_stack([b.column(f"k{i}").to_numpy() for i in range(LEVELS)]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(routes.bucket(keys)), b.column("n")], ["bucket", "n"])  # noqa: B023

        loads = drawn.mapInArrow(buckets, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("load")).toArrow()
        load = np.zeros(1 << BUCKETS, np.int64)
        load[loads.column("bucket").to_numpy()] = loads.column("load").to_numpy()
        hot = load > shard_tokens
        if not hot.any() or len(routes.hot) == LEVELS - 1:
            break
        routes = Routes([*routes.hot, hot], routes.start, routes.parts)
    cold = np.where(hot, 0, load)
    before = np.cumsum(cold) - cold
    start = before // shard_tokens
    parts = np.where(hot, -(-load // shard_tokens), 1)
    more = np.where(hot, parts, 0)
    start = np.where(hot, start.max() + 1 + np.cumsum(more) - more, start)
    return Routes(routes.hot, start, parts)


def _placed(idf, routes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shard = routes.value.shard(_keys(idf.value, *_unpacked(batch, bits)), batch.column("salt").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(c) for c in ("doc_id", "n", "packed"))], ["shard", "doc_id", "n", "packed"])
        T.release()

    return run


class Index:
    """BM25 over one shard's documents."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, idf: np.ndarray, mean: float):
        doc, term, tf = _terms(ids, off)
        size = np.diff(off)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1.0)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        term_s = term[order]
        self.terms = term_s[np.append(True, term_s[1:] != term_s[:-1])]
        self.first = np.searchsorted(term_s, np.append(self.terms, np.iinfo(np.int64).max))
        self.n = len(size)
        self.at = np.searchsorted(doc, np.arange(self.n + 1))
        self.slot = np.searchsorted(self.terms, term)  # of each document's distinct terms, all of which are looked up
        common = np.flatnonzero(np.diff(self.first) * DENSE > self.n)
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        self.held = np.empty((max(1, HELD // max(1, 8 * self.n)), self.n))
        row = self.row[self.slot]
        self.dense[row[row >= 0], doc[row >= 0]] = weight[row >= 0]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all distinct terms of the seed."""
        slot = self.slot[self.at[seed] : self.at[seed + 1]]
        row = self.row[slot]
        rows = row[row >= 0]
        score = np.zeros(self.n)
        for i in range(0, len(rows), len(self.held)):  # through one buffer, which stays in the cache
            part = rows[i : i + len(self.held)]
            score += np.take(self.dense, part, axis=0, out=self.held[: len(part)], mode="clip").sum(0)
        parts = [slice(int(self.first[s]), int(self.first[s + 1])) for s in slot[row < 0].tolist()]
        if parts:
            score += np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), self.n)
        return score

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents, best first; those without a common term last. Ordered as
        far as they are asked for."""
        left = np.flatnonzero(unused)
        cost = -self.scores(seed)[left]
        done = 0
        while done < len(left):
            k = 64 if not done else len(left)
            if done + k < len(left):
                bound = np.partition(cost, k)[k]
                best = np.flatnonzero(cost < bound)
                best = best[np.argsort(cost[best], kind="stable")]
            else:
                best = np.argsort(cost, kind="stable")[done:]
            yield from left[best].tolist()
            done += len(best)
            if not len(best):  # more ties than that
                yield from left[np.argsort(cost, kind="stable")].tolist()
                return


def plan(ids: np.ndarray, off: np.ndarray, index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    size = np.diff(off)
    unused = np.ones(len(size), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, at, nxt = 0, 0, 0
    seed, done = -1, 0  # the document being placed and how much of it is
    queue: Iterator[int] = iter(())
    while True:
        if seed < 0:
            found = next((x for x in queue if unused[x]), -1) if at else -1
            if found >= 0:
                seed = found
            else:
                while nxt < len(size) and not unused[nxt]:
                    nxt += 1
                if nxt == len(size):
                    break
                seed = nxt
            unused[seed], done = False, 0
        if not at:  # it opens the window
            queue = index.ranked(seed, unused) if int(size[seed]) - done < window else iter(())
        take = min(int(size[seed]) - done, window - at)
        pieces.append((seed, done, take, sequence, at))
        done += take
        at += take
        if at == window:
            sequence, at = sequence + 1, 0
        if done == size[seed]:
            seed = -1
    return _without_padding(pieces, window) if at else pieces


def _without_padding(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """The last, unfilled sequence cut into sequences of powers of two."""
    last = pieces[-1][3]
    tail = [p for p in pieces if p[3] == last]
    out = [p for p in pieces if p[3] != last]
    left = sum(p[2] for p in tail)
    room, sequence, at = 0, last - 1, 0
    for doc, start, length, _, _ in tail:
        while length:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                sequence, at = sequence + 1, 0
            take = min(length, room)
            out.append((doc, start, take, sequence, at))
            start, length, room, at = start + take, length - take, room - take, at + take
    return out


def _packed(idf, mean: float, bits: int):
    def run(key, t):
        shard = key[0].as_py()
        t = t.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("packed", "ascending")]) if t.num_rows > 1 else t
        ids, off = _unpacked(t.combine_chunks(), bits)
        pieces = plan(ids, off, Index(ids, off, idf.value, mean))
        T.release()  # the index
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        ids4 = ids.astype("<u4")
        crc = [zlib.crc32(ids4[a : a + n]) for a, n in zip((off[doc] + start).tolist(), length.tolist())]
        docs = t.column("doc_id").to_numpy()[doc]
        return pa.table(
            {
                "doc_id": pa.array(docs, pa.int64(), mask=docs == S.MAX_ID),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(np.diff(off)[doc]),
                "sequence_id": pa.array((shard << 24) + sequence),
                "offset": pa.array(offset),
            }
        )

    return run


def _table(docs: DataFrame, file: str, end_id: int) -> tuple[DataFrame, int, int, int, np.ndarray]:
    """Packed ids of all documents (doc_id, n, packed, written), bits an id, ids,
    documents, and the idf of every id."""
    from tokenizers import Tokenizer

    T.bounded_batches(docs.sparkSession)
    bits = width_of(max(Tokenizer.from_file(file).get_vocab_size(), end_id + 1))
    rows = T.written(docs.select("doc_id", "text").mapInArrow(_encode(file, end_id, bits), "doc_id long, n long, packed binary"), "packed-ids")
    total, n_docs = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counts = rows.mapInArrow(_counts(bits), "first long, counts binary").groupBy("first").applyInArrow(_summed, "first long, counts binary")
    df = np.zeros(1 << bits, np.int64)
    for r in counts.collect():  # one entry an id of the vocabulary
        got = np.frombuffer(r["counts"], np.int64)
        df[r["first"] : r["first"] + len(got)] = got
    return rows, bits, total, n_docs, np.log1p((n_docs - df + 0.5) / (df + 0.5))


def pack(docs: DataFrame, file: str, end_id: int = END_ID, shard_tokens: int | None = None) -> DataFrame:
    """Pieces of all documents of ``docs`` (null text: empty, just the end id).
    A null doc_id counts as the greatest and comes back null; rows of one doc_id are
    documents of their own. No rows give no pieces. Larger shards bring seeds nearer
    to the best neighbours of the corpus and cost more; one shard has them all."""
    spark = docs.sparkSession
    rows, bits, total, n_docs, idf = _table(docs, file, end_id)
    idf = spark.sparkContext.broadcast(idf)
    drawn = T.written(rows.select("n", "packed").mapInArrow(_drawn(idf, bits), _DRAWN), "drawn-terms")
    routes = spark.sparkContext.broadcast(_routes(drawn, shard_tokens or SHARD_TOKENS))  # 2^BUCKETS entries
    placed = rows.withColumn("salt", F.monotonically_increasing_id()).mapInArrow(_placed(idf, routes, bits), "shard long, doc_id long, n long, packed binary")
    return placed.groupBy("shard").applyInArrow(_packed(idf, total / max(1, n_docs), bits), PIECES)


def search(docs: DataFrame, seeds: Column, k: int, file: str, end_id: int = END_ID) -> DataFrame:
    """Exact retrieval over all documents: (seed, doc_id, score, rank), the ``k``
    documents of ``docs`` other than itself that have the greatest BM25 for all terms
    of each document for which ``seeds`` holds (say, doc_id % 50 = 0); ties by doc_id.
    Every block of documents is scored for every seed, block by block of seeds, and
    gives its ``k`` best, so the work is their product: for measuring recall, not for
    packing. Rows without a doc_id are left out."""
    spark = docs.sparkSession
    rows, bits, total, n_docs, idf = _table(docs, file, end_id)
    idf, mean = spark.sparkContext.broadcast(idf), total / max(1, n_docs)
    known = rows.where("doc_id is not null").withColumn("salt", F.monotonically_increasing_id())
    blocks = max(1, -(-total // SHARD_TOKENS))
    asked = known.where(seeds)
    many = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS))
    left = known.select(F.pmod(F.xxhash64("salt"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("part"), F.lit(False).alias("seed"), "doc_id", "salt", "n", "packed")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("salt"), F.lit(many)).cast("int").alias("part"), F.lit(True).alias("seed"), "doc_id", "salt", "n", "packed")

    def best(t: pa.Table) -> pa.Table:
        t = t.sort_by([("seed", "ascending"), ("doc_id", "ascending"), ("salt", "ascending")]).combine_chunks()
        ids, off = _unpacked(t, bits)
        doc, salt, seed = (t.column(c).to_numpy() for c in ("doc_id", "salt", "seed"))
        own = int((~seed).sum())
        index, out = Index(ids, off, idf.value, mean), []
        for s in range(own, len(doc)):
            score = index.scores(s)[:own]
            score[salt[:own] == salt[s]] = -1
            top = np.argsort(-score, kind="stable")[: k + 1]
            out += [(int(salt[s]), int(doc[s]), int(doc[x]), float(score[x])) for x in top.tolist() if score[x] > 0][:k]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, f) for c, f in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["salt", "seed", "doc_id", "score"])

    found = left.unionByName(right).groupBy("block", "part").applyInArrow(best, "salt long, seed long, doc_id long, score double")
    rank = F.row_number().over(W.partitionBy("salt").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("salt")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(T.table(spark, sf_dir, "documents"), K.path("word_bpe_49k.json"))
