"""Byte-level BPE, encoding and decoding.

Encoding a pre-token: its bytes are a doubly linked list of symbols; a priority
queue holds the rank and place of every pair that merges. The least rank is merged
first, leftmost first among equals; an entry whose place no longer holds that pair
is stale and skipped; a merge queues the two pairs it forms. Decoding concatenates
the vocabulary's byte strings. The vocabulary file is a parameter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import textkit as T
from . import tokens as K

PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoding:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _alphabet()
        ids = spec["model"]["vocab"]
        self.vocabulary: dict[int, bytes] = {i: bytes(byte[c] for c in s) for s, i in ids.items()}
        self.single = [0] * 256
        for c, b in byte.items():
            self.single[b] = ids[c]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] << 32 | ids[b]] = r
            self.merged.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocabulary |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pre = regex.compile(PRE_TOKEN)
        self.decimal = {i: str(i).encode() for i in self.vocabulary}

    def merge(self, data: bytes) -> list[int]:
        """ids of one pre-token's bytes."""
        rank, merged = self.rank, self.merged
        symbol = [self.single[b] for b in data]
        n = len(symbol)
        queue = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << 32 | symbol[i + 1])
            if r is not None:
                queue.append(r << 32 | i)
        if not queue:
            return symbol
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << 32 | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = merged[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = rank.get(symbol[i] << 32 | symbol[k])
                if x is not None:
                    heappush(queue, x << 32 | i)
            p = before[i]
            if p >= 0:
                x = rank.get(symbol[p] << 32 | symbol[i])
                if x is not None:
                    heappush(queue, x << 32 | p)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> list[int]:
        if self.split and self.split.search(text):
            out: list[int] = []
            for k, part in enumerate(self.split.split(text)):
                out += [self.special[part]] if k % 2 else self.encode(part)
            return out
        pieces = self.pre.findall(text)
        if len(pieces) == 1:
            return self.merge(text.encode())
        return [i for p in pieces for i in self.merge(p.encode())]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.encode, texts))

    def decode(self, ids) -> bytes:
        """The bytes that ids stand for (text cut inside a character has partial ones)."""
        return b"".join(map(self.vocabulary.__getitem__, ids))


_MODELS: dict[str, tuple[BytePairEncoding, K.PieceEncoder]] = {}


def _model(file: str) -> tuple[BytePairEncoding, K.PieceEncoder]:
    if file not in _MODELS:
        model = BytePairEncoding(file)
        _MODELS[file] = model, K.PieceEncoder(model.encode_all, list(model.special), True)
    return _MODELS[file]


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, SHA-256 of the decimal ids
    joined by commas and of the decoded text. Null text is empty: no ids. Rows are
    independent, so any doc_id, repeated or null, passes through."""
    T.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = _model(file)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        decimal = model.decimal.__getitem__
        for t in T.blocks(batches):
            ids, off = pieces.ids(t.column("text"))
            of_ids, of_text = [], []
            for a, b in zip(off.tolist(), off[1:].tolist()):
                own = ids[a:b].tolist()
                of_ids.append(sha(b",".join(map(decimal, own))))
                of_text.append(sha(model.decode(own).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(np.diff(off), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(T.table(spark, sf_dir, "documents"), K.path("byte_bpe_50k.json"))
