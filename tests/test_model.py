"""Three read paths against a dictionary: 24 ids over several flushed layers with
updates, deletes and merges; point reads, structured scans with tight budgets in
both directions, and SQL."""

import random

import pytest

from recordloom.operators import predicates as P
from recordloom.operators.scan import ScanRequest, pages
from recordloom.plans.sql import SqlQuery
from recordloom.sources.store import Batch, Store
from recordloom.types import Value


def layer(r):
    """Operations of revision r: (slot, None | (attrs, contents))."""
    for slot in range(24):
        sel = slot * 31 + r * 17
        if r and sel % 5 == 0:
            continue
        if r and sel % 13 == 0:
            yield slot, None
            continue
        attrs = [("kind", ["plan", "call", "tool"][(slot + 2 * r) % 3]), ("score", slot * 17 - r * 29 - 200), ("ratio", (slot - r) / 8), ("active", (slot + r) % 2 == 0), ("epoch", Value.uint((1 << 64) - 1 - slot * 16 - r)), ("raw", bytes([0, slot, r, 255])), ("at", Value.timestamp_ns(-1_700_000_000_000_000_000 + slot * 100 + r))]
        attrs += [("nil", None)] if (slot + r) % 4 == 0 else []
        attrs += [("tag", f"first-{slot}"), ("tag", f"second-{r}")]
        contents = {"body": (f"common prefix {'shared ' * 32}|slot={slot}|revision={r}|" + "tail" * ((slot + r) % 11)).encode()}
        if (slot + r) % 3:
            contents["attachment"] = f"attachment/{slot:04d}/{r}:{'same' * 9}".encode()
        yield slot, (attrs, contents)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    model = {}
    s = Store.open(spark, tmp_path_factory.mktemp("model") / "s")
    for r in range(4):
        batch = Batch()
        for slot, what in layer(r):
            id = f"record/{slot:04d}"
            if what is None:
                batch.delete(id)
                model.pop(id, None)
            else:
                batch.put(id, *what)
                model[id] = ([(n, Value.of(v)) for n, v in what[0]], what[1])
        s.apply(batch)
        if r < 3:
            s.flush()
        if r == 2:
            s.merge_range(1, 2)
    yield s, model
    s.close()


def first(attrs, name, tag):
    return next((v for n, v in attrs if n == name and v.tag == tag), None)


CASES = {
    "all": ((), lambda a, c: True),
    "score": ((P.Attr("score", "gte", Value.int(-60)),), lambda a, c: first(a, "score", 1).raw >= -60),
    "ratio": ((P.Attr("ratio", "lt", Value.float(0.5)),), lambda a, c: first(a, "ratio", 2).python < 0.5),
    "nil": ((P.Attr("nil", "eq", Value.null()),), lambda a, c: first(a, "nil", 7) is not None),
    "first tag only": ((P.Attr("tag", "eq", Value.str("second-2")),), lambda a, c: False),
    "attachment": ((P.ContentExists("attachment", False), P.Attr("active", "eq", Value.bool(True))), lambda a, c: "attachment" not in c and first(a, "active", 3).raw),
    "epoch": ((P.Attr("epoch", "ne", Value.uint((1 << 64) - 1)),), lambda a, c: first(a, "epoch", 4).raw != (1 << 64) - 1),
}


@pytest.mark.parametrize("name", CASES)
def test_scan_over_the_writer(both, name):
    s, model = both
    tests, holds = CASES[name]
    want = sorted(i for i, (a, c) in model.items() if holds(a, c))
    rng = random.Random(name)
    for reverse in (False, True):
        request = ScanRequest(predicates=tests, reverse=reverse, limit=rng.randint(5, 9), max_examined=rng.randint(6, 12), max_resolution_entries=rng.randint(20, 40), contents=(("body", "bytes"), ("attachment", "metadata")), max_reconstructed_bytes=2500)
        got = [r for page in pages(s, s._fold(), request) for r in page.rows]
        assert [r.id for r in got] == (want[::-1] if reverse else want)
        for r in got:
            attrs, contents = model[r.id]
            assert r.attrs == attrs and r.contents["body"]["bytes"] == contents["body"] and r.contents["attachment"]["present"] == ("attachment" in contents)


def test_point_reads_and_sql(both):
    s, model = both
    assert s.scan_ids(limit=100) == sorted(model)
    for id in ("record/0000", "record/0005", "record/0013"):
        got = s.get(id)
        assert (got.attrs if got else None) == (model[id][0] if id in model else None)
        assert s.read_content(id) == (model[id][1]["body"] if id in model else None)
    snap = s.snapshot()
    q = SqlQuery(snap, "SELECT id, score, kind, body FROM records WHERE score >= $1 ORDER BY id", [-60])
    got = [(r["id"], r["score"], r["kind"], bytes(r["body"])) for r in q.df.collect()]
    assert got == [(i, first(a, "score", 1).raw, first(a, "kind", 0).raw, c["body"]) for i, (a, c) in sorted(model.items()) if first(a, "score", 1).raw >= -60]
    assert snap.schema().contents == ("attachment", "body") and dict(snap.schema().attributes)["nil"] == ("null",)
    assert s.verify()["contents"] == sum(len(c) for _, c in model.values())
