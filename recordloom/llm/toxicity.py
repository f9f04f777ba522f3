"""Toxicity by multiple-instance learning.

Method: a document is a bag of sentences. A sentence's logit is linear in hashed
features of its words (the word, and its first 4, 5 and 6 bytes, as insults are
inflected and compounded); the document's score is the noisy-or of its sentences'
probabilities. Only document labels are used: the gradient of the bag's likelihood
says which sentences must be to blame. The model then names the worst sentence.

Sentences end at ``.``, ``!``, ``?`` or a line break. Nothing but the text enters a
score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch as S
from . import textkit as T
from .textkit import U64

#: Hashed features.
BITS = 18
#: At most so many labelled rows of each label, and bytes of their texts, are learnt
#: from: whole texts in order of a hash of doc_id, those that don't fit passed over;
#: the learner weighs the labels back to their shares.
SAMPLE = {1: 1500, 0: 3000}
SAMPLE_BYTES = {1: 8 << 20, 0: 16 << 20}
#: Steps with all features, and with those the L1 penalty left.
STEPS = (40, 150)
RATE = 0.1
L1 = 0.2
LEAST = 3
#: Features summed at a time: bounds the driver's temporaries.
CHUNK = 1 << 20
THRESHOLD = 0.3

_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]{}<>#*$%&|")] = True
_LENGTHS = (4, 5, 6)
PER_WORD = 1 + len(_LENGTHS)


@dataclass
class Bags:
    """Sentences of rows: per sentence its byte span and features; offsets."""

    feature: np.ndarray  # of words, PER_WORD each
    word_sentence: np.ndarray
    sentence_row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    off: np.ndarray
    rows: int


def bags(col: pa.Array) -> Bags:
    buf, off = T.buffers(col)
    buf = T.lower_ascii(buf)
    starts, ends, woff = T.word_spans(buf, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    # a sentence ends with a word whose last bytes hold a stop, or at a line break
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    bound = np.append(starts[1:], len(buf)) if len(starts) else starts
    last = stops[bound] > stops[starts]
    last[:-1] |= row[1:] != row[:-1]
    sentence = np.concatenate([[0], np.cumsum(last[:-1])]) if len(starts) else np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(starts) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(starts)) - 1 if len(head) else head
    # trimmed words
    s, e = starts.copy(), ends.copy()
    for _ in range(3):
        cut = (e - s > 1) & _TRIM[buf[e - 1]]
        e = e - cut
        cut = (e - s > 1) & _TRIM[buf[s]]
        s = s + cut
    out = np.empty((len(s), PER_WORD), np.int32)
    out[:, 0] = (T.word_hashes(buf, s, e) >> U64(64 - BITS)).astype(np.int32)
    for k, n in enumerate(_LENGTHS, 1):
        h = T.mix(T.word_hashes(buf, s, np.minimum(e, s + n)) + U64(n))
        out[:, k] = (h >> U64(64 - BITS)).astype(np.int32)
    return Bags(out, sentence, row[head], starts[head], ends[tail], off, len(off) - 1)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def logits(self, b: Bags) -> np.ndarray:
        z = self.weight[b.feature].sum(1)
        return np.bincount(b.word_sentence, z, len(b.sentence_row)) + self.bias

    def scores(self, b: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or per row (no sentences: 0), and the sentences' probabilities."""
        z = self.logits(b)
        survive = np.bincount(b.sentence_row, np.logaddexp(0, z), b.rows)
        return -np.expm1(-survive), 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(feature: np.ndarray, word_sentence: np.ndarray, sentence_row: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Full-batch proximal Adam on the weighted log-likelihood of the bags. Features
    of fewer than LEAST bags are left out; after the first steps only features that
    the L1 penalty left nonzero go on."""
    rows, sentences = len(label), len(sentence_row)
    total = weight.sum()
    flat = feature.ravel()
    owner = np.repeat(word_sentence.astype(np.int32), feature.shape[1])
    bags_with = np.zeros(1 << BITS, np.int32)
    edges = np.searchsorted(sentence_row, np.arange(rows + 1))
    cuts = np.searchsorted(owner, edges)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        bags_with[np.unique(flat[a:b])] += 1
    keep = bags_with[flat] >= LEAST
    flat, owner = flat[keep], owner[keep]
    del keep
    share = float((weight * label).sum() / total)
    bias = float(np.log(max(share, 1e-3) / max(1.0, sentences / rows))) - 2
    out = np.zeros(1 << BITS)
    place = np.zeros(1 << BITS, np.int32)
    for steps in STEPS:
        used = np.unique(flat)
        place[used] = np.arange(len(used))
        f, w = place[flat], out[used]
        parts = [slice(i, i + CHUNK) for i in range(0, len(f), CHUNK)]
        m, v = np.zeros_like(w), np.zeros_like(w)
        mb = vb = 0.0
        for step in range(1, steps + 1):
            z = np.full(sentences, bias)
            for part in parts:
                z += np.bincount(owner[part], w[f[part]], sentences)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            survive = np.bincount(sentence_row, np.logaddexp(0, z), rows)
            one = np.maximum(-np.expm1(-survive), 1e-9)
            dz = p * (np.where(label == 1, -np.exp(-survive) / one, 1.0) * weight / total)[sentence_row]
            g, gb = np.zeros(len(used)), float(dz.sum())
            for part in parts:
                g += np.bincount(f[part], dz[owner[part]], len(used))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            w = w - RATE * (m / c1) / (np.sqrt(v / c2) + 1e-7)
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0)
            bias -= 2 * RATE * (mb / c1) / ((vb / c2) ** 0.5 + 1e-7)
        out[:] = 0
        out[used] = w
        keep = out[flat] != 0
        flat, owner = flat[keep], owner[keep]
    return Model(out.astype(np.float32), bias)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in T.blocks(batches):
        b = bags(t.column("text"))
        word_row = b.sentence_row[b.word_sentence] if len(b.word_sentence) else b.word_sentence
        edge = np.searchsorted(word_row, np.arange(b.rows + 1))
        first = np.searchsorted(b.sentence_row, np.arange(b.rows))
        feature, sentence = [], []
        for i in range(b.rows):
            x, y = int(edge[i]), int(edge[i + 1])
            feature.append(b.feature[x:y].tobytes())
            sentence.append((b.word_sentence[x:y] - first[i]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("toxic").combine_chunks(), pa.array(feature, pa.binary()), pa.array(sentence, pa.binary())], ["doc_id", "toxic", "feature", "sentence"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the rows of ``labels`` (doc_id, toxic), at most SAMPLE rows and
    SAMPLE_BYTES of each label; rows of null doc_id or label are left out, a doc_id
    with several labels counts as toxic, and rows with the same doc_id and text count
    once. With no labelled toxic row nothing is toxic."""
    T.bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE[1]).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE[0]))
    # at most SAMPLE ids are broadcast; one id may have any number of rows
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(picked), "doc_id")
    sizes = texts.groupBy("doc_id", "toxic", "h").agg(F.max(F.octet_length("text")).alias("n"))
    chosen = []
    for label in (1, 0):
        left = SAMPLE_BYTES[label]
        for r in sizes.where(F.col("toxic") == label).orderBy(order, "doc_id", "h").limit(SAMPLE[label]).collect():
            if (r["n"] or 0) <= left:
                left -= r["n"] or 0
                chosen.append((r["doc_id"], r["h"]))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long")
    texts = texts.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "toxic", "h").agg(F.first("text").alias("text"))
    rows = texts.select("doc_id", "text", "toxic").mapInArrow(_gather, "doc_id long, toxic int, feature binary, sentence binary").toArrow().sort_by("doc_id")
    label = rows.column("toxic").to_numpy()
    word_sentence, sentence_row, base = [], [], 0
    for i, x in enumerate(rows.column("sentence").to_pylist()):
        own = np.frombuffer(x, np.int32)
        n = int(own[-1]) + 1 if len(own) else 0
        word_sentence.append(own + np.int32(base))
        sentence_row.append(np.full(n, i, np.int32))
        base += n
    if not counts.get(1) or not base:
        return Model(np.zeros(1 << BITS, np.float32), -20.0)
    feature = np.frombuffer(b"".join(x for c in rows.column("feature").chunks for x in c.to_pylist()), np.int32).reshape(-1, PER_WORD)
    del rows
    have = {k: max(1, int((label == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(k, 0) / have[k] for k in label.tolist()])
    model = train(feature, np.concatenate(word_sentence), np.concatenate(sentence_row), label, weight)
    T.release()
    return model


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id's decimal text modulo 4 is 2; a null id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence: its bytes' start
    and end, and its probability (null without sentences). Null and empty texts
    score 0; rows are independent, so any doc_id, repeated or null, passes."""
    T.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in T.blocks(batches):
            b = bags(t.column("text"))
            total, each = held.value.scores(b)
            edge = np.searchsorted(b.sentence_row, np.arange(b.rows + 1))
            order = np.lexsort((-each, b.sentence_row))
            some = np.diff(edge) > 0
            worst = order[edge[:-1][some]]
            place = np.full(b.rows, -1)
            place[some] = worst
            none = ~some
            pick = lambda a: a[np.maximum(place, 0)] if len(a) else np.zeros(b.rows, a.dtype)
            ids = t.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("doc_id").cast(pa.int64()).combine_chunks(),
                    pa.array([held_out(i) for i in ids], pa.bool_()),
                    pa.array(np.clip(total, 0, 1), pa.float64()),
                    pa.array((total >= THRESHOLD).astype(np.int32)),
                    pa.array(pick(b.begin) - b.off[:-1], pa.int64(), mask=none),
                    pa.array(pick(b.end) - b.off[:-1], pa.int64(), mask=none),
                    pa.array(pick(each), pa.float64(), mask=none),
                ],
                ["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worst_start long, worst_end long, worst_score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "labels")
    learnt = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return score(docs, fit(docs, learnt))
