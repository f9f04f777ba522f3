"""N-gram Jaccard join: every pair of documents whose sets of 5-word shingles
overlap by at least ``percent`` of their union, without losing a link. Shingles are
told apart by 64-bit hashes: a link is wrong only where two unlike ones share one.

Method: vertical partitioning. The global order of shingles (rare first) is cut
into fragments; each fragment counts the overlaps of its own shingles, and the
counts are summed per pair. What makes that scale:

1. A sharded sketch (``sketch``) tells for every document how many of its
   shingles surely occur nowhere else. A document with more of those than a link
   allows has no partner; nearly all leave here, and no shingle of theirs moves.
2. Documents with equal sets form one class; one representative stays, with the
   number of its copies, so a group of any number of copies costs one document.
3. Shards of the hash range count among representatives how many have each
   shingle, which gives the global order and a second, exact, cut as in 1.
4. Two linked documents share a shingle among their rarest few (prefix). Those
   connect representatives to neighbourhoods; a neighbourhood, or each of its prefix
   shingles if that copies fewer sets, is cut into tiles of at most ``TILE``
   documents a side, each a task of its own.
5. A tile takes the fragments of the order one after another. A pair is opened
   only by a prefix shingle both have; each fragment adds its partial overlap.

Passages that many documents share are frequent, hence last in the order, and
open no pairs. A tile returns degrees and a spanning forest, not all its links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import sketch as S
from . import textkit as T
from .components import components
from .textkit import U64

SIZE = 5
PERCENT = 90
#: Documents on a side of a tile.
TILE = 1024
#: Fragments of the global order within a tile.
FRAGMENTS = 8
#: Shingles a counting shard gets, on average.
SHARD = 2_000_000


def _sets(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within it, and row offsets."""
    buf, off = T.buffers(t.column("text"))
    buf = T.lower_ascii(buf)
    starts, ends, woff = T.word_spans(buf, off)
    words = T.word_hashes(buf, starts, ends)
    first, row = T.windows_in(woff, size)
    h = T.window_hashes(words, size)[first] if len(first) else np.zeros(0, np.uint64)
    short = np.flatnonzero((np.diff(woff) > 0) & (np.diff(woff) < size))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for i, r in enumerate(short.tolist()):
            a, b = int(woff[r]), int(woff[r + 1])
            whole[i] = T.mix(T.window_hashes(words[a:b], b - a) + U64(b - a))[0]
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    edge = np.searchsorted(row, np.arange(len(off)))
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    h, row = h[~same], row[~same]
    return h, np.searchsorted(row, np.arange(len(off)))


def _need(n, percent: int):
    """The least overlap a document of n shingles needs for a link."""
    return -(-n * percent // 100)


def _measured(shape: S.Shape, place: tuple[str, int], size: int, percent: int):
    """Per document: set size, and, if it may have a partner, a class key and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, blocks in X.units(batches):
            sets = [_sets(t, size) for t in blocks]
            flags = S.repeated(shape, place, unit, np.concatenate([h for h, _ in sets]))
            done = rows = 0
            for t, (h, off) in zip(blocks, sets):
                maybe = flags[done : done + len(h)]
                yield _documents(t, h, off, maybe, percent, unit, rows)
                done, rows = done + len(h), rows + t.num_rows

    return run


def _documents(t: pa.Table, h: np.ndarray, off: np.ndarray, maybe: np.ndarray, percent: int, unit: str, first: int) -> pa.RecordBatch:
    n = np.diff(off)
    total = np.concatenate([[0], np.cumsum(maybe)])
    shared = total[off[1:]] - total[off[:-1]]
    alive = (n > 0) & (shared >= _need(n, percent))
    k1, k2, sets = [], [], []
    for i in np.flatnonzero(alive).tolist():
        own = h[off[i] : off[i + 1]]
        a, b = T.mix(own), T.mix(own ^ U64(0xA5A5A5A55A5A5A5A))
        k1.append(int(a.sum(dtype=np.uint64).view(np.int64)))
        k2.append(int(b.sum(dtype=np.uint64).view(np.int64)))
        sets.append(own.tobytes())
    spread = lambda v: [next(it) if ok else None for it in [iter(v)] for ok in alive.tolist()]
    return pa.RecordBatch.from_arrays(
        [t.column("doc_id").cast(pa.int64()).combine_chunks(), t.column("text_key").combine_chunks(), pa.array(n, pa.int64()), pa.array(spread(k1), pa.int64()), pa.array(spread(k2), pa.int64()), pa.array(spread(sets), pa.binary()), pa.array([unit] * len(n), pa.string()), pa.array(np.arange(first, first + len(n)))],
        ["doc_id", "text_key", "n", "k1", "k2", "hashes", "unit", "place"],
    )


UNIT = "unit string, reps array<long>, ns array<long>, copies array<long>, hashes binary"


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives' sets in rows of some megabytes: units of the exchange."""
    held, size = [], 0

    def close() -> pa.RecordBatch:
        reps, ns, copies, sets = zip(*held)
        lists = [pa.array([list(c)], pa.list_(pa.int64())) for c in (reps, ns, copies)]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, pa.array([b"".join(sets)], pa.binary())], ["unit", "reps", "ns", "copies", "hashes"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "copies", "hashes"))):
            held.append(row)
            size += len(row[3])
            if size > X.BATCH_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _shingles(hashes: bytes) -> X.Entries:
    return np.unique(np.frombuffer(hashes, np.uint64), return_counts=True)


def _orders(row: dict, percent: int, shift: int, counts: tuple[str, int]) -> Iterator[tuple]:
    """Of the representatives of a unit that may still have a partner: (rep, n, copies,
    their shared shingles in the global order (count, then hash), counts, and how many
    of them are the prefix)."""
    every = np.frombuffer(row["hashes"], np.uint64)
    e = _shingles(row["hashes"])
    count = X.answers_of(counts, row["unit"], X.Count(), e, shift)[np.searchsorted(e[0], every)]
    at = 0
    for rep, n, copies in zip(row["reps"], row["ns"], row["copies"]):
        h, c = every[at : at + n], count[at : at + n]
        at += n
        many = c > 1
        h, c = h[many], c[many]
        alone, spare = n - len(h), n - _need(n, percent)
        if alone <= spare:
            order = np.lexsort((h, c))
            yield rep, n, copies, h[order], c[order], min(len(h), spare + 1 - alone)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _prefixes(percent: int, shift: int, counts: tuple[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            found = [(rep, h[:prefix].view(np.int64)) for rep, _, _, h, _, prefix in _orders(row, percent, shift, counts)]
            reps = np.repeat(np.array([r for r, _ in found], np.int64), [len(h) for _, h in found])
            yield pa.RecordBatch.from_arrays([pa.array([row["unit"]] * len(reps), pa.string()), pa.array(reps), pa.array(np.concatenate([np.zeros(0, np.int64), *(h for _, h in found)]))], ["unit", "rep", "token"])
            T.release()

    return run


def _on_tiles(percent: int, shift: int, counts: tuple[str, int], places: tuple[str, int]):
    """Sets of placed representatives, once for each of their tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            goes: dict[int, list[list[str]]] = {}
            for x in X.read_replies(places, row["unit"]):
                goes.setdefault(x["shard"], []).append(x["bits"].decode().split(","))
            out, size = [], 0
            for rep, n, copies, h, c, prefix in _orders(row, percent, shift, counts) if goes else ():
                raw = h.tobytes(), c.astype(np.int32).tobytes()
                for area, token, chunk, chunks in goes.get(rep, ()):
                    own = int(chunk)
                    for other in range(int(chunks)):
                        out.append((int(area), int(token) if token else None, min(own, other), max(own, other), rep, n, copies, own, *raw, prefix))
                        size += len(raw[0])
                        if size > X.BATCH_BYTES:
                            yield _tile_rows(out)
                            out, size = [], 0
            if out:
                yield _tile_rows(out)
            T.release()

    return run


ON_TILES = "area long, token long, i long, j long, rep long, n long, copies long, chunk long, hashes binary, counts binary, prefix_n long"


def _tile_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary() if c.split()[1] == "binary" else pa.int64() for c in ON_TILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in ON_TILES.split(", ")])


TILED = "rep long, degree long, other long"


def _tile(percent: int):
    """One tile: partial overlaps by fragment, summed; links, as degrees (copies
    counted) and the edges of a spanning forest. A pair of an area's tile is opened by
    any prefix shingle both have; one of a shingle's tile if that is their first."""

    def run(key, t):
        own, i, j = (key[k].as_py() for k in (1, 2, 3))
        rep, n, copies, side = (t.column(c).to_numpy() for c in ("rep", "n", "copies", "chunk"))
        order = np.lexsort((rep, side))
        rep, n, copies, side = rep[order], n[order], copies[order], side[order]
        hashes, counts, prefix = (t.column(c).to_pylist() for c in ("hashes", "counts", "prefix_n"))
        hashes = [np.frombuffer(hashes[x], np.uint64) for x in order.tolist()]
        counts = [np.frombuffer(counts[x], np.int32) for x in order.tolist()]
        prefix = np.array(prefix, np.int64)[order]
        m = len(rep)
        doc = np.repeat(np.arange(m), [len(x) for x in hashes])
        h, c = np.concatenate(hashes), np.concatenate(counts)
        pos = np.arange(len(h)) - np.repeat(np.cumsum([0] + [len(x) for x in hashes[:-1]]), [len(x) for x in hashes])
        early = pos < prefix[doc]
        order = np.lexsort((doc, h, c))  # the global order
        h, c, doc, early = h[order], c[order], doc[order], early[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        token = np.cumsum(new) - 1
        tokens = int(token[-1]) + 1 if len(token) else 0
        two = i != j
        if own is None:
            opened = _pairs(token[early], doc[early], side, two, m)
        else:
            mine = int(token[np.flatnonzero(h == np.int64(own).view(np.uint64))[0]])
            before = early & (token < mine)
            every = _pairs(np.zeros(m, np.int64), np.arange(m), side, two, m)
            opened = np.setdiff1d(every, _pairs(token[before], doc[before], side, two, m), assume_unique=True)
        if not len(opened):
            return pa.table({"rep": pa.array([], pa.int64()), "degree": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        a, b = opened // m, opened % m
        fits = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
        a, b = a[fits], b[fits]
        overlap = np.zeros(len(a), np.int64)
        cuts = np.searchsorted(token, np.linspace(0, tokens, FRAGMENTS + 1).astype(np.int64))
        for lo, hi in zip(cuts, cuts[1:]):
            overlap += _partial(token[lo:hi], doc[lo:hi], a, b, m)
        link = overlap * 100 >= percent * (n[a] + n[b] - overlap)
        a, b = a[link], b[link]
        degree = np.bincount(a, copies[b], m).astype(np.int64) + np.bincount(b, copies[a], m).astype(np.int64)
        root = list(range(m))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        other: list[int | None] = [None] * m
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
        for x in np.flatnonzero(degree).tolist():
            other[x] = int(rep[find(x)])
        live = np.flatnonzero(degree)
        return pa.table({"rep": pa.array(rep[live], pa.int64()), "degree": pa.array(degree[live], pa.int64()), "other": pa.array([other[x] for x in live.tolist()], pa.int64())})

    return run


def _pairs(token: np.ndarray, doc: np.ndarray, side: np.ndarray, two: bool, m: int) -> np.ndarray:
    """Distinct pairs of documents that share a token, as lesser * m + greater; with
    two sides, only pairs across. Lists of one length are taken together."""
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(token)))
    found = [np.zeros(0, np.int64)]
    held = 0
    for k in np.unique(length[length > 1]).tolist():
        lists = start[length == k]
        x, y = np.triu_indices(k, 1)
        step = max(1, 2_000_000 // len(x))
        for s in range(0, len(lists), step):
            at = doc[lists[s : s + step, None] + np.arange(k)]
            p, q = at[:, x].ravel(), at[:, y].ravel()
            if two:
                across = side[p] != side[q]
                p, q = p[across], q[across]
            found.append(np.unique(np.minimum(p, q) * m + np.maximum(p, q)))
            held += len(found[-1])
            if held > 4_000_000:
                found = [np.unique(np.concatenate(found))]
                held = 0
    return np.unique(np.concatenate(found))


def _partial(token: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """Overlap of each pair within one fragment."""
    out = np.zeros(len(a), np.int64)
    if not len(token):
        return out
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    edge = np.searchsorted(doc, np.arange(m + 1))
    size = np.diff(edge)
    width = int(token.max()) + 1
    held = doc * width + token
    swap = size[a] > size[b]
    x, y = np.where(swap, b, a), np.where(swap, a, b)
    done = 0
    total = np.cumsum(size[x])
    while done < len(a):
        base = int(total[done - 1]) if done else 0
        stop = max(done + 1, int(np.searchsorted(total, base + 2_000_000, "right")))
        k = size[x[done:stop]]
        which = np.repeat(np.arange(done, stop), k)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        probe = y[which] * width + token[edge[x[which]] + inner]
        at = np.minimum(np.searchsorted(held, probe), len(held) - 1)
        out[done:stop] = np.bincount(which[held[at] == probe] - done, minlength=stop - done)
        done = stop
    return out


def text_key():
    return F.xxhash64("text")


def rows(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (``text_key()``), n_shingles, n_similar (other documents linked
    directly), component_id (smallest doc_id reachable by links), group_key (one of
    each set of rows that links connect; null without any), and unit and place (where
    the row is in ``docs``), for every row of ``docs``.

    Null text has no words; documents without words have an empty set and no
    links; with fewer than ``size`` words the whole sequence is the one shingle.
    ``docs`` must be a table (the same rows at each reading). Rows of
    one doc_id are documents of their own; a row with null doc_id is left out of the join and returned with its
    set size, no links and no component."""
    spark = docs.sparkSession
    T.bounded_batches(spark)
    X.pin_splits(docs)
    known = docs.select("doc_id", "text", text_key().alias("text_key"))
    out = T.fresh_dir(spark, "linked-documents")
    with T.scope(spark):
        return T.written(_rows(known, size, percent), "linked-documents", out)


def _rows(known: DataFrame, size: int, percent: int) -> DataFrame:
    spark = known.sparkSession
    whole = S.total_bytes(known)
    shape = S.Shape.of(whole // 6, 1, per_hash=16)
    place = S.estimate(known, shape, lambda t: _sets(t, size)[0], whole, "shingles-estimated")
    at = T.written(known.mapInArrow(_measured(shape, place, size, percent), "doc_id long, text_key long, n long, k1 long, k2 long, hashes binary, unit string, place long").withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    # one set of each class, the copies of a task dropped before the shuffle
    live = at.where("k1 is not null and doc_id is not null").groupBy("k1", "k2", "n")
    classes = T.written(live.agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("hashes").alias("hashes")), "shingle-classes")
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    units = T.written_wide(classes.select("rep", "n", "copies", "hashes").mapInArrow(_united, UNIT), T.fresh_dir(spark, "shingle-units"))
    cut = max(2, int(np.ceil(np.log2(max(1, tokens / SHARD)))))
    first = min(cut, X.FAN)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((u, _shingles(h)) for b in batches for u, h in zip(b.column("unit").to_pylist(), b.column("hashes").to_pylist()))
        yield from X.messages(X.Count(), found, 64 - first)

    counts = X.file_replies(units.select("unit", "hashes").mapInArrow(send, X.SENT), X.Count(), 64, first, cut, X.FAN, 8 * tokens, "shingle-counts")
    heads = T.written(units.mapInArrow(_prefixes(percent, 64 - first, counts), "unit string, rep long, token long"), "prefixes")
    places = T.fresh_dir(spark, "tile-places"), X._files(8 * tokens)
    placed = _places(heads)
    bits = F.encode(F.concat_ws(",", F.col("area").cast("string"), F.coalesce(F.col("token").cast("string"), F.lit("")), F.col("chunk").cast("string"), F.col("chunks").cast("string")), "UTF-8")
    X.file_rows(placed.select("unit", F.col("rep").alias("shard"), bits.alias("bits")), places)
    tiles = units.mapInArrow(_on_tiles(percent, 64 - first, counts, places), ON_TILES)
    tiled = T.written(tiles.groupBy("area", "token", "i", "j").applyInArrow(_tile(percent), TILED), "shingle-links")
    joined = components(tiled.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    degree = tiled.groupBy("rep").agg(F.sum("degree").alias("degree"))
    joined = joined.withColumnRenamed("node", "rep")
    least = joined.join(classes.select("rep", "first_id"), "rep").groupBy("component").agg(F.min("first_id").alias("least_id"))
    group = classes.drop("hashes").join(degree, "rep", "left").join(joined.join(least, "component"), "rep", "left")
    group = group.select("k1", "k2", "n", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("component", "rep").alias("group_key"))
    return (
        at.drop("hashes")
        .join(group, ["k1", "k2", "n"], "left")
        .select(
            "doc_id",
            "text_key",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_similar", F.lit(0))).cast("long").alias("n_similar"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
            F.when(F.col("doc_id").isNotNull(), F.col("group_key")).alias("group_key"),
            "unit",
            "place",
        )
    )


def _places(heads: DataFrame) -> DataFrame:
    """(unit, rep, area, token, chunk, chunks): the tiles that representatives go on,
    those (area, token, i, j) of which ``chunk`` is i or j; at most TILE a side.

    Prefix shingles (``heads``: unit, rep, token) connect representatives to areas. An
    area of m goes on tiles as a whole (token null), each set copied to every chunk of
    its area, or its shingles each get tiles of their own, each set copied to those of
    its prefix: whichever copies less. So a large group of near-copies, all of whose
    pairs must be compared, costs its square over TILE, and a long chain of documents
    that share a shingle or two with their neighbours costs its length."""
    chunks = lambda k: F.ceil(F.col(k) / TILE).cast("long")
    tokens = T.written(heads.groupBy("token").agg(F.min("rep").alias("least"), F.count("*").alias("k")).where("k > 1"), "prefix-shingles")
    star = heads.join(tokens, "token")
    near = T.written(components(star.select(F.col("rep").alias("a"), F.col("least").alias("b"))), "neighbourhoods")
    costs = tokens.join(near.withColumnRenamed("node", "least"), "least").groupBy("component").agg(F.sum(F.col("k") * chunks("k")).alias("by_token"))
    sizes = near.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    areas = sizes.join(costs, "component").select(F.col("component").alias("area"), "m", (F.col("by_token") < F.col("m") * chunks("m")).alias("split"))
    placed = near.select(F.col("node").alias("rep"), F.col("component").alias("area")).join(areas, "area")
    whole = heads.select("unit", "rep").distinct().join(placed.where("not split"), "rep").select("unit", "rep", "area", F.lit(None).cast("long").alias("token"), chunks("m").alias("chunks"))
    single = star.join(placed.where("split").select("rep", "area"), "rep").select("unit", "rep", "area", "token", chunks("k").alias("chunks"))
    return whole.unionByName(single).withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks"))


def first_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each set of rows that links connect: the one with the
    smallest doc_id (then hash of the text). Rows without a doc_id stay. ``docs`` must
    be a table. Rows are told apart by their place in the table, whose text isn't
    moved: each unit of it looks up which of its rows go."""
    spark = docs.sparkSession
    places = T.fresh_dir(spark, "near-copies"), X._files(S.total_bytes(docs))
    with T.scope(spark):
        every = rows(docs, size, percent)  # a table already, that lasts as long as this scope
        row = F.struct("doc_id", "text_key", "unit", "place")
        linked = every.where("n_similar > 0").withColumn("row", row)
        first = linked.groupBy("group_key").agg(F.min("row").alias("first"))
        gone = linked.join(first, "group_key").where("row <> first").select("unit", F.col("place").alias("shard"))
        # every unit has an entry, so that one which has changed is noticed
        known = every.select("unit").distinct().select("unit", F.lit(-1).cast("long").alias("shard"))
        X.file_rows(gone.unionByName(known).withColumn("bits", F.lit(b"")), places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, blocks in X.units(batches):
            places_gone = np.array([x["shard"] for x in X.read_replies(places, unit)], np.int64)
            if not len(places_gone):
                raise RuntimeError(f"documents have changed between two passes (unit {unit}); write them to a table first")
            at = 0
            for t in blocks:
                yield from t.filter(pa.array(~np.isin(np.arange(at, at + t.num_rows), places_gone))).to_batches()
                at += t.num_rows

    return docs.mapInArrow(run, docs.schema)


def links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of ``rows``."""
    return rows(docs, size, percent).select("doc_id", "n_shingles", "n_similar", "component_id")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(T.table(spark, sf_dir, "documents"))


# Shingles as joined words; overlaps by a self-join on shingles; components by
# a recursive walk along the links.
OP5_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a AS node, b AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT count(*) FROM l WHERE l.a = w.doc_id) AS n_similar,
       least(w.doc_id, coalesce((SELECT min(reach) FROM r WHERE r.node = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
