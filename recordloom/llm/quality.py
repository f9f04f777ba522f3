"""Quality rules: rule statistics of every text, judged by an isolation forest.

Method: random trees split a bounded, documented sample of all documents on one
statistic at a time; a document that few splits isolate (short average path) is
anomalous. Statistics within the usual range of labelled good rows count as equal, so
what is isolated is what lies beyond it. How short a path is too short is calibrated
on labelled rows: the threshold that finds most rows of quality 0 for the rows of
quality 1 it loses, of which there are at most ``ALLOWED``. Range and threshold come
from all labelled rows. Two base rules reject outright. Statistics are exact, over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import sketch as S
from . import textkit as T
from .textkit import U64

#: Documents the forest is grown on: of all that pass the base rules, the ones with
#: the least hash of doc_id.
SAMPLE = 8192
TREES = 128
PER_TREE = 256
#: The threshold may lose at most this share of labelled good rows, and within that
#: losing one per cent of them weighs as much as missing COST per cent of the poor.
ALLOWED = 0.02
COST = 5
#: Share of good rows beyond either end of the usual range of a statistic.
OUTSIDE = 0.002
#: Scores are counted in so many bins.
BINS = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Symbols, repeated lines a line, repeated words, capitals a character, marks, and
#: characters a word. Of the last a low value may be bad too. The number of words is
#: left to the base rules.
FEATURES = ["symbols", "dup_lines", "repeats", "capitals", "marks", "word_length"]


def _repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the hashes occur more than once in their row."""
    own = T.mix(h + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    values, many = S.distinct(np.sort(own))
    many = values[many]
    if not len(many):
        return np.zeros(len(h), bool)
    return many[np.minimum(np.searchsorted(many, own), len(many) - 1)] == own


def statistics(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the five base statistics (int64), and the forest's features."""
    buf, off = T.buffers(col)
    rows = len(off) - 1
    starts, ends, woff = T.word_spans(buf, off)

    def per_row(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flag), off))

    blank = per_row(T._SPACE[buf])
    word_chars = np.diff(off) - per_row((buf & 0xC0) == 0x80) - blank
    n_words = np.diff(woff)
    n_symbols = per_row(_SYMBOL[buf])
    # windows of three words that their text has again
    words = T.word_hashes(buf, starts, ends)
    first, row = T.windows_in(woff, 3)
    at = first[_repeats(T.window_hashes(words, 3)[first], row)] if len(first) else first
    step = np.bincount(at, minlength=len(starts) + 1) - np.bincount(at + 3, minlength=len(starts) + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[: len(starts)]) > 0)])
    n_repeat = covered[woff[1:]] - covered[woff[:-1]]
    # lines with a word, equal to an earlier one of their text
    breaks = np.flatnonzero(buf == 0x0A)
    begin = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begin = begin[begin < len(buf)]
    stop = np.append(begin[1:], len(buf))
    line_row = np.searchsorted(off, begin, "right") - 1
    stop = np.where((stop > begin) & (buf[np.maximum(stop - 1, 0)] == 0x0A), stop - 1, stop) if len(begin) else stop
    wordy = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, line_row = begin[wordy], stop[wordy], line_row[wordy]
    own = T.mix(T.word_hashes(buf, begin, stop) + line_row.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
    _, one = np.unique(own, return_index=True)
    again = np.ones(len(own), bool)
    again[one] = False
    n_dup = np.bincount(line_row[again], minlength=rows)
    lines = np.bincount(line_row, minlength=rows)
    base = np.column_stack([n_words, word_chars, n_symbols, n_dup, n_repeat]).astype(np.int64).reshape(rows, 5)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.column_stack([n_symbols / w, n_dup / np.maximum(lines, 1), n_repeat / w, per_row(_UPPER[buf]) / c, per_row(_MARK[buf]) / w, word_chars / w])
    return base, features.reshape(rows, len(FEATURES))


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has children 2i+1 and 2i+2; a feature of
    -1 marks a leaf, whose value is its depth plus the mean depth of what it holds."""

    feature: np.ndarray
    value: np.ndarray
    norm: float

    @staticmethod
    def _mean_path(n: int) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @staticmethod
    def grow(x: np.ndarray, seed: int = 7) -> Forest:
        rng = np.random.Generator(np.random.PCG64(seed))
        size = min(PER_TREE, len(x))
        depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        nodes = (1 << (depth + 1)) - 1
        feature, value = np.full((TREES, nodes), -1, np.int32), np.zeros((TREES, nodes))
        for t in range(TREES):
            todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])] if size else []
            while todo:
                i, d, rows = todo.pop()
                spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
                if d == depth or len(rows) <= 1 or not len(spread):
                    value[t, i] = d + Forest._mean_path(len(rows))
                    continue
                f = int(rng.choice(spread))
                at = rng.uniform(rows[:, f].min(), rows[:, f].max())
                feature[t, i], value[t, i] = f, at
                low = rows[:, f] <= at
                todo += [(2 * i + 1, d + 1, rows[low]), (2 * i + 2, d + 1, rows[~low])]
        return Forest(feature, value, max(Forest._mean_path(size), 1e-9))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 to the minus mean path over its expectation."""
        path = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value in zip(self.feature, self.value):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > value[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            path += value[at]
        return np.exp2(-path / TREES / self.norm)


@dataclass
class Model:
    forest: Forest
    low: np.ndarray
    high: np.ndarray
    threshold: float

    def excess(self, x: np.ndarray) -> np.ndarray:
        """How far statistics lie beyond their usual range, on a logarithmic scale:
        above it for all, below it for the length of words."""
        above = np.log1p(np.maximum(x - self.high, 0) / np.maximum(self.high, 0.01))
        below = np.log1p(np.maximum(self.low[-1:] - x[:, -1:], 0) / np.maximum(x[:, -1:], 0.01))
        return np.concatenate([above, below], axis=1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.forest.scores(self.excess(features))

    def judge(self, base: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and which texts are kept."""
        score = self.scores(features)
        return score, ~base_failed(base) & (score <= self.threshold)


MEASURED = ", ".join([*(f"{c} long" for c in BASE), "base_failed boolean", *(f"{c} double" for c in FEATURES)])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and the forest's statistics of every
    text, null text being empty: all that ``fit`` and ``judge`` need, without text."""
    T.bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in T.blocks(batches):
            base, features = statistics(t.column("text"))
            columns = [t.column("doc_id").combine_chunks(), *map(pa.array, base.T), pa.array(base_failed(base)), *map(pa.array, features.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {MEASURED}")


def _matrix(t: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy() for c in names]) if t.num_rows else np.zeros((0, len(names)))


def fit(measured: DataFrame, labels: DataFrame | None) -> Model:
    """From the rows of ``measure`` and of ``labels`` (doc_id, quality; of several the
    greatest counts). The usual range of each statistic is what all but OUTSIDE of
    the rows of quality 1 that pass the base rules have; the forest is grown on SAMPLE
    of all rows that pass them; its threshold follows from all labelled rows, counted
    by score. Without labels all rows set the range, and without rows of quality 0
    the threshold is the greatest score of quality 1. Give a written table: it is
    read several times."""
    spark = measured.sparkSession
    T.bounded_batches(spark)
    passing = measured.where("not base_failed")
    if labels is None:
        known = passing.withColumn("quality", F.lit(1))
    else:
        marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        known = passing.join(marks, "doc_id")
    ends = known.where("quality <> 0").agg(*(F.percentile_approx(c, [OUTSIDE, 1 - OUTSIDE], 100_000).alias(c) for c in FEATURES)).first()
    low, high = (np.array([ends[c][k] if ends[c] else 0.0 for c in FEATURES]) for k in (0, 1))
    x = _matrix(passing.select("doc_id", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(SAMPLE).select(*FEATURES).toArrow(), FEATURES)
    model = Model(Forest.grow(x[:0]), low, high, 1.0)
    x = model.excess(x)
    model.forest = Forest.grow(x[np.lexsort(x.T)])  # rows come in any order; the forest shall not depend on it
    held = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = held.value.scores(_matrix(b, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(np.ceil(score * BINS).astype(np.int64))], ["quality", "bin"])

    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in known.select("quality", *FEATURES).mapInArrow(binned, "quality int, bin long").groupBy("quality", "bin").count().collect():
        (bad if r["quality"] == 0 else good)[min(r["bin"], BINS)] += r["count"]
    model.threshold = _threshold(good, bad)
    return model


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """From counts by score bin: the best trade of poor rows found for good ones lost."""
    if not good.any():
        return 1.0
    top = int(np.flatnonzero(good)[-1])
    if not bad.any():
        return top / BINS
    lost = 1 - np.cumsum(good) / good.sum()
    found = 1 - np.cumsum(bad) / bad.sum()
    gain = np.where(lost <= ALLOWED, found - COST * lost, -np.inf)
    gain[top + 1 :] = -np.inf
    return float(np.flatnonzero(gain == gain.max())[-1]) / BINS  # the most lenient of equals



def judge(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id and the statistics, base_failed, kept and anomaly of every row of
    ``measure``. Null text has no words and fails the base rules; doc_id may be null
    or repeated."""
    held = measured.sparkSession.sparkContext.broadcast(model)  # TREES x 511 nodes at most
    kind = dict(measured.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, kept = held.value.judge(_matrix(b, BASE), _matrix(b, FEATURES))
            names = ["doc_id", *BASE, "base_failed"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept), pa.array(score)], [*names, "kept", "anomaly"])

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return measured.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows the rules reject; all columns pass through."""
    T.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in T.blocks(batches):
            _, kept = held.value.judge(*statistics(t.column("text")))
            yield from t.filter(pa.array(kept)).to_batches()

    assert isinstance(docs.schema["text"].dataType, StringType)
    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = T.written(measure(T.table(spark, sf_dir, "documents")), "rule-statistics")
    return judge(measured, fit(measured, T.table(spark, sf_dir, "labels")))
