"""Encoding of whole texts with a public tokenizer, through a cache of pieces.

The vocabularies used here split a text before they merge, and no token spans
  * the boundary before a single space between two non-spaces (byte-level
    vocabulary: the space belongs to the next piece; word-level: it is dropped),
  * either side of a single newline between two non-spaces,
  * the boundary between a Latin letter and a sentence mark.
So a text is cut there, with numpy over its bytes, and its ids are its pieces' ids
in a row. A piece that came before costs a look-up of its 64-bit hash in a bounded
table; the others go to the encoder, each distinct one once. Texts that hold
special tokens' strings or spaces beyond ASCII go to the encoder whole.

Pieces are told apart by their 64-bit hashes alone: two of one hash in a worker's
table would get the same ids. Among a table's CACHE pieces that happens with a
probability of about 4e-8.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textkit as T
from .textkit import U64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker remembers.
CACHE = 1_200_000
#: New pieces that go to the library as one text, with a special token in between.
JOINED = 100

_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
#: Bytes that begin or are spaces other than the six of ASCII, or other separators.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def odd_rows(buf: np.ndarray, off: np.ndarray, specials: list[bytes]) -> np.ndarray:
    """Rows to be encoded whole: with a special token's string, or with any space
    or separator that the cutting rules don't know."""
    at = np.flatnonzero(_SUSPECT[buf])
    pad = np.concatenate([buf, np.zeros(3, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    bad = a < 0x20
    bad |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    bad |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    bad |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    bad |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hits = [at[bad]]
    for s in specials:
        first = np.flatnonzero(buf == s[0])
        for i, x in enumerate(s[1:], 1):
            if not len(first):
                break
            first = first[first + len(s) <= len(buf)]
            first = first[buf[first + i] == x]
        hits.append(first)
    rows = np.unique(np.searchsorted(off, np.concatenate(hits), "right") - 1)
    return rows


def cut(buf: np.ndarray, off: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and the piece offsets of the rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    blank = T._SPACE[buf]
    begin = edge[:-1].copy()
    mark = np.flatnonzero(_MARK[buf])
    last = mark[mark > 0] - 1
    begin[last[_ends_latin(buf, last)] + 1] = True
    after = mark[mark < n - 1] + 1
    begin[after[_starts_latin(buf, after)]] = True
    if spaced:
        lone = np.zeros(n, bool)
        lone[1:-1] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
        lone &= ~edge[:-1] & ~edge[1:]
        begin |= lone & (buf == 0x20)
        line = np.flatnonzero(lone & (buf == 0x0A))
        begin[line] = True
        begin[line + 1] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, off)
    inside = ~blank
    begin[1:] |= blank[:-1]
    begin &= inside
    starts = np.flatnonzero(begin)
    stop = np.zeros(n + 1, bool)
    stop[1:-1] = begin[1:] | (inside[:-1] & blank[1:]) | edge[1:-1]
    stop[n] = True
    stop[1:] &= inside
    return starts, np.flatnonzero(stop), np.searchsorted(starts, off)


def _starts_latin(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a Latin letter (ASCII, or of the block after it) starts at a byte."""
    second = buf[np.minimum(at + 1, len(buf) - 1)]
    return _ALPHA[buf[at]] | ((buf[at] == 0xC3) & (second != 0x97) & (second != 0xB7))


def _ends_latin(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether one ends there."""
    byte = buf[at]
    return _ALPHA[byte] | ((buf[np.maximum(at - 1, 0)] == 0xC3) & (at > 0) & (byte != 0x97) & (byte != 0xB7))


class _Table:
    """Open addressing from nonzero 64-bit hashes to small integers, by numpy."""

    def __init__(self, size: int):
        self.mask = U64((1 << max(12, (size * 2).bit_length())) - 1)
        self.key = np.zeros(int(self.mask) + 1, np.uint64)
        self.value = np.zeros(int(self.mask) + 1, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        slot = h & self.mask
        while len(left):
            key = self.key[slot]
            hit = key == h[left]
            out[left[hit]] = self.value[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + U64(1)) & self.mask
        return out

    def put(self, h: np.ndarray, v: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        slot = h & self.mask
        while len(h):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[free]
            mine = free & (self.key[slot] == h)
            self.value[slot[mine]] = v[mine]
            h, v, slot = h[~mine], v[~mine], (slot[~mine] + U64(1)) & self.mask


class PieceEncoder:
    """ids of texts. ``encode`` gives the ids of each of a list of strings."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], specials: list[str], spaced: bool, limit: int = CACHE, whole: Callable[[list[str]], list[list[int]]] | None = None):
        self.encode, self.whole, self.specials, self.spaced, self.limit = encode, whole or encode, [s.encode() for s in specials], spaced, limit
        self._empty()

    def _empty(self) -> None:
        self.table = _Table(self.limit * 5 // 4)
        self.hashes = np.zeros(0, np.uint64)
        self.flat, self.start, self.size, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts of an Arrow column in a row (null: none), and the
        offsets of the texts."""
        buf, off = T.buffers(col)
        odd = odd_rows(buf, off, self.specials)
        if not len(odd):
            return self._ids(buf, off)
        size = np.diff(off)
        whole = [buf[off[i] : off[i + 1]].tobytes().decode() for i in odd.tolist()]
        got = self.whole(whole)
        keep = np.repeat(~np.isin(np.arange(len(size)), odd), size)
        size[odd] = 0
        flat, at = self._ids(buf[keep], np.concatenate([[0], np.cumsum(size)]))
        parts, last = [], 0
        n = np.diff(at)
        for i, g in zip(odd.tolist(), got):
            parts += [flat[last : at[i]], np.array(g, np.uint32)]
            last = at[i]
            n[i] = len(g)
        return np.concatenate([*parts, flat[last:]]), np.concatenate([[0], np.cumsum(n)])

    def _ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.spaced:
            buf = T.lower_ascii(buf)
        starts, ends, poff = cut(buf, off, self.spaced)
        h = T.word_hashes(buf, starts, ends)
        h[h == 0] = 1
        code = self.table.get(h)
        new = np.flatnonzero(code < 0)
        if len(new):
            if len(self.hashes) + len(new) > self.limit:
                self._trim()
                code = self.table.get(h)
                new = np.flatnonzero(code < 0)
            fresh, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            raw = buf.tobytes()
            got = self.encode([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])  # none holds a special token
            code[new] = self._learn(fresh, got)[back]
        self.used += np.bincount(code, minlength=len(self.used))
        n = self.size[code].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.start[code] - total[:-1], n) + np.arange(int(total[-1]))
        return self.flat[at], total[poff]

    def _learn(self, fresh: np.ndarray, got: list[list[int]]) -> np.ndarray:
        base = len(self.hashes)
        size = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        self.hashes = np.concatenate([self.hashes, fresh])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        codes = np.arange(base, base + len(fresh))
        if len(self.hashes) > self.limit * 5 // 4:  # one block with more pieces than the table takes
            self.table = _Table(len(self.hashes) * 2)
            self.table.put(self.hashes, np.arange(len(self.hashes)))
        else:
            self.table.put(fresh, codes)
        return codes

    def _trim(self) -> None:
        """Forgets the pieces used least, at least half of them."""
        often = int(np.sort(self.used)[len(self.used) // 2]) + 1 if len(self.used) else 0
        keep = np.flatnonzero(self.used >= often)
        hashes, size, start, flat = self.hashes[keep], self.size[keep], self.start[keep], self.flat
        n = size.astype(np.int64)
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self._empty()
        self.hashes, self.size, self.flat = hashes, size, flat[at]
        self.start = np.cumsum(n) - n
        self.used = np.zeros(len(keep), np.int64)
        self.table.put(hashes, np.arange(len(keep)))


_ENCODERS: dict[str, PieceEncoder] = {}


def library_encoder(file: str) -> PieceEncoder:
    """An encoder over the tokenizers library's file, one per worker."""
    if file not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        added = tokenizer.get_added_tokens_decoder()
        specials = [t.content for t in added.values()]
        # a special token ends a text as far as encoding goes; one that takes no blanks joins
        marks = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]

        def one_by_one(strings: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

        def encode(strings: list[str]) -> list[list[int]]:
            out: list[list[int]] = []
            for i in range(0, len(strings), 20_000):
                part = strings[i : i + 20_000]
                if not marks or len(part) < 2 * JOINED:
                    out += one_by_one(part)
                    continue
                mark, text = marks[0]
                joined = [text.join(part[j : j + JOINED]) for j in range(0, len(part), JOINED)]
                flat: list[int] = []
                for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                    flat += e.ids
                    flat.append(mark)
                a = 0
                for b in np.flatnonzero(np.array(flat) == mark).tolist():
                    out.append(flat[a:b])
                    a = b + 1
            return out

        _ENCODERS[file] = PieceEncoder(encode, specials, type(tokenizer.pre_tokenizer).__name__ == "ByteLevel", whole=one_by_one)
    return _ENCODERS[file]
