"""Secret scans through a trigram inverted index.

Method: each rule's regular expression is parsed into a Boolean query over the
trigrams any match must contain (exact strings are multiplied out where small, cut
where not; alternatives become OR). Each block of documents gets an inverted index
of the trigrams the rules ask for; a rule's postings are intersected and united,
and only those candidates are verified with the regular expression. A rule with no
mandatory trigram scans every text. Trigrams are of lower-cased ASCII, so they
serve rules of either case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as T

try:  # the regular expression parser of the standard library
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # pragma: no cover - older Pythons
    import sre_constants as sre
    import sre_parse as sre_parser

#: Exact strings a part of a pattern may multiply out to.
EXACT = 64

ANY = True


def _and(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list):
    if any(p is ANY for p in parts) or not parts:
        return ANY
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(s: str):
    raw = s.encode()
    return _and([raw[i : i + 3] for i in range(len(raw) - 2)])


def _members(items) -> set[str] | None:
    """Lower-cased characters of a class, if few."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    out = {_low(c) for c in out}
    return out if len(out) <= 8 else None


def _low(c: str) -> str:
    return c.lower() if c < "\x80" else c


def _walk(items) -> tuple[set[str] | None, object]:
    """(exact strings or None, query) of a parsed sequence."""
    run: set[str] = {""}
    query: list = []
    exact = True

    def cut() -> None:
        nonlocal run, exact
        query.append(_or([_grams(s) for s in run]))
        run, exact = {""}, False

    for op, arg in items:
        inner: set[str] | None
        more = ANY
        again = False
        if op is sre.LITERAL:
            inner = {_low(chr(arg))}
        elif op is sre.IN:
            inner = _members(arg)
        elif op is sre.SUBPATTERN:
            inner, more = _walk(arg[3])
        elif op is sre.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            inner = set().union(*(s[0] for s in sides)) if all(s[0] is not None for s in sides) else None
            more = _or([s[1] for s in sides])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            low, high, body = arg
            inner, more = _walk(body)
            if low == 0:
                more = ANY
                inner = {"", *inner} if inner is not None and high == 1 else None
            elif high != 1:
                again = True
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            inner = {""}
        else:
            inner = None
        if inner is not None and len(run) * len(inner) <= EXACT:
            run = {a + b for a in run for b in inner}
        else:
            cut()
            query.append(more)
            if inner is not None and len(inner) <= EXACT:
                run = set(inner)
        if again:
            cut()
            query.append(more)
    if exact:
        return run, _or([_grams(s) for s in run])
    cut()
    return None, _and(query)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression: ANY, a trigram, or an
    ("and" | "or", ...) tuple. Every text with a match satisfies it."""
    return _walk(sre_parser.parse(pattern))[1]


def trigrams(query) -> set[bytes]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1:]))


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches shorter than ``least`` (in ``group``) are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)

    @cached_property
    def query(self):
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")

#: The base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a maximal run of 16 or more is what [0-9a-f]+ finds, less the short ones
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further kinds, by their public formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"Bearer [A-Za-z0-9+/_.=-]{20,}"),
    # starts where a run of scheme characters does, so that a long run is read once
    Rule("url_login", r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\s/:@]++:[^\s/:@]{3,}+@"),
)
RULES = BASE_RULES + MORE_RULES


class Index:
    """Postings of the wanted trigrams over the texts of one block."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, wanted: tuple[bytes, ...]):
        self.rows = len(off) - 1
        self.postings: dict[bytes, np.ndarray] = {g: np.zeros(0, np.int64) for g in wanted}
        if len(buf) < 3 or not wanted:
            return
        low = T.lower_ascii(buf).astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(_lut(wanted)[code])
        row = np.searchsorted(off, at, "right") - 1
        inside = at + 3 <= off[row + 1]
        code, row = code[at[inside]], row[inside]
        for g in wanted:
            self.postings[g] = np.unique(row[code == int.from_bytes(g, "big")])

    def candidates(self, query) -> np.ndarray:
        if query is ANY:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.candidates(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


@cache
def _lut(wanted: tuple[bytes, ...]) -> np.ndarray:
    out = np.zeros(1 << 24, bool)
    out[[int.from_bytes(g, "big") for g in wanted]] = True
    return out


def find(col: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, end, number of the rule), ascending by start, then
    rule; in code points. Null text has none."""
    buf, off = T.buffers(col)
    wanted = tuple(sorted(set().union(*(trigrams(r.query) for r in rules))))
    index = Index(buf, off, wanted)
    whole = buf.tobytes()
    texts: dict[int, str] = {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    for k, rule in enumerate(rules):
        for i in index.candidates(rule.query).tolist():
            text = texts.get(i)
            if text is None:
                text = texts[i] = whole[off[i] : off[i + 1]].decode()
            out[i] += [(a, b, k) for a, b in rule.spans(text)]
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


def _listed(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base kinds' spans) and
    spans (of all kinds) of every text. Null and empty texts have none; rows are
    independent, so any doc_id, repeated or null, passes through."""
    T.bounded_batches(docs.sparkSession)
    base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in T.blocks(batches):
            found = find(t.column("text"), rules)
            own = [[s for s in spans if s[2] < base] for spans in found]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in own], pa.int64()) for k in range(base)]
            sha = [hashlib.sha256(_listed(spans, rules).encode()).hexdigest() for spans in own]
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").cast(pa.int64()).combine_chunks(), *counts, pa.array(sha, pa.string()), pa.array([_listed(s, rules) for s in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mask`` (touching and overlapping
    spans by one); other columns pass through, texts without secrets unchanged."""
    T.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in T.blocks(batches):
            old = t.column("text").to_pylist()
            new = []
            for text, spans in zip(old, find(t.column("text"), rules)):
                if spans:
                    parts, last = [], 0
                    for a, b, _ in spans:
                        if a > last or not parts:
                            parts += [text[last:a], mask]
                        last = max(last, b)
                    text = "".join([*parts, text[last:]])
                new.append(text)
            yield from t.set_column(t.column_names.index("text"), "text", pa.array(new, pa.string())).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(T.table(spark, sf_dir, "documents"))
