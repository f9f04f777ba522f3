import json
import random

import pytest

from recordloom.errors import InvalidArgument
from recordloom.functions import dialect
from recordloom.operators.content import Carve, by_content, json_elements
from recordloom.operators.introspect import Schema, nearest_rank, plan_compaction
from recordloom.operators.scan import prefix_upper_bound
from recordloom.plans.lens import columns
from recordloom.plans.sql import rewrite
from recordloom.sources import importers
from recordloom.sources.store import Store
from recordloom.types import Value, bits_of


def slow_cuts(body, target):
    from recordloom.operators.content import _gear

    table, mask = [int(x) for x in _gear()], (1 << 64) - 1
    import math

    bits = round(math.log2(target))
    strict, loose, least, most = min(bits + 2, 63), max(bits - 2, 1), target // 4, target * 4
    out, start = [], 0
    while start < len(body):
        if len(body) - start <= least:
            out.append((start, len(body)))
            break
        hard, h, cut = min(start + most, len(body)), 0, None
        for i in range(start, hard):
            h = ((h << 1) + table[body[i]]) & mask
            if i >= start + least and h >> (64 - (strict if i < min(start + target, hard) else loose)) == 0:
                cut = i + 1
                break
        out.append((start, cut or hard))
        start = cut or hard
    return out


def test_cuts_by_content_are_those_of_the_plain_loop():
    rng = random.Random(3)
    for n in (0, 5, 63, 64, 1000, 40_000):
        for target in (64, 100, 256, 1024):
            body = bytes(rng.randrange(256) for _ in range(n))
            assert by_content(body, target) == slow_cuts(body, target)
            assert by_content(b"ab" * n, target) == slow_cuts(b"ab" * n, target)


@pytest.mark.parametrize("body", [b"", b"[]", b"tiny", b'[1 ,{"a":"]\\"[,"}, "x,y" ]  ', b'{"a":[1]}', b"[1,2", b'["a', b" [ [1,[2]], 3]", b"[,]", b"x" * 9000])
def test_spans_are_the_body(body):
    for c in (Carve(), Carve("cdc", 64), Carve("whole"), Carve("inline"), Carve("messages", intra=64)):
        spans = c.spans(body)
        assert b"".join(body[s : s + n] for _, s, n in spans) == body
        assert all(n for _, _, n in spans)


def test_elements_reach_their_delimiter():
    assert [b'[1 ,{"a":"]"}, "x"]'[a:b] for a, b in json_elements(b'[1 ,{"a":"]"}, "x"]')] == [b"1 ", b'{"a":"]"}', b'"x"']
    assert json_elements(b"[1") is None and json_elements(b"{}") is None and json_elements(b"[]") == []
    assert json_elements(b"[1,\x0b2]") == [(1, 2), (3, 5)] and json_elements(b"[1,\x0c2]") == [(1, 2), (4, 5)]


def test_lens_names():
    s = Schema((("a", ("str", "int")), ("a#str", ("str",)), ("body", ("str",)), ("id", ("int",)), ("n", ("null",))), ("body", "x"))
    assert [c[0] for c in columns(s)] == ["id", "body", "content.x", "a#str", "a#int", "a#str#str", "body#str", "id#int", "n#null"]


def test_prefix_bound():
    assert prefix_upper_bound("ab") == "ac" and prefix_upper_bound("") is None and prefix_upper_bound("\U0010ffff") is None
    assert prefix_upper_bound("a퟿") == "a" and prefix_upper_bound("a\U0010ffff") == "b"


def test_plans():
    assert nearest_rank([5, 1, 3], 50) == 3 and nearest_rank([1, 2], 95) == 2 and nearest_rank([], 50) == 0
    assert plan_compaction([(1, 10), (1, 10), (1, 10)], 8, 2, 100) == (0, 2)
    assert plan_compaction([(1, 1)], 8, 9, 9) is None
    with pytest.raises(Exception, match="cheapest"):
        plan_compaction([(5, 10), (5, 10)], 8, 2, 100)


def test_values_on_the_wire():
    for v in (Value.str("x"), Value.int(-1), Value.bits(1 << 63), Value.bool(False), Value.uint((1 << 64) - 1), Value.binary(b"\0\xff"), Value.timestamp_ns(-1), Value.null()):
        assert Value.decode(json.loads(json.dumps(v.encode()))) == v
    for bad in ({"type": "i64", "decimal": "01"}, {"type": "u64", "decimal": "-1"}, {"type": "f64", "bitsHex": "F" * 16}, {}):
        with pytest.raises(InvalidArgument):
            Value.decode(bad)


def test_parameters_are_rewritten_outside_quotes():
    assert rewrite("a = $1 AND b = '$2' -- $3\nAND \"$1\" = $2", 2) == "a = :p1 AND b = '$2' -- $3\nAND \"$1\" = :p2"
    with pytest.raises(InvalidArgument):
        rewrite("$3", 2)


def test_equality_of_floats_is_by_bits(spark):
    from pyspark.sql import functions as F

    from recordloom import types as RT
    from recordloom.operators import predicates

    nan = float("nan")
    xs = [0.0, -0.0, 1.0, -1.5, 5e-324, float("inf"), float("-inf"), nan, 1e-310, None]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", F.array(RT.attr("f", "float", F.col("x"))).alias("attrs"))
    for y in [x for x in xs if x is not None]:
        for op in ("eq", "ne"):
            got = {r["i"] for r in table.where(predicates.Attr("f", op, Value.float(y)).column()).collect()}
            assert got == {i for i, x in enumerate(xs) if x is not None and (bits_of(x) == bits_of(y)) == (op == "eq")}
    assert table.where(predicates.Attr("f", "eq", Value.bits(0x7FF8000000000001)).column()).isEmpty()
    assert [Value.from_row(r["attrs"][0]) for r in table.orderBy("i").collect()[:4]] == [Value.float(x) for x in xs[:4]]


def test_dialect(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(dialect.gcd(F.lit(12), F.lit(-18)).alias("g"), dialect.lcm(F.lit(4), F.lit(6)).alias("l"), dialect.lcm(F.lit((1 << 53) + 1), F.lit(2)).alias("large"), dialect.lcm(F.lit(0), F.lit(0)).alias("zero"), dialect.trunc_number(F.lit(-1.29), 1).alias("t"), dialect.to_hex(F.lit(255)).alias("h"), dialect.regexp_match(F.lit("a1b2"), "([a-z])([0-9])").alias("m"), dialect.date_bin(900_000_000, F.lit("2024-01-01 10:17:00").cast("timestamp")).cast("string").alias("d")).first()
    assert (r["g"], r["l"], r["t"], r["h"], r["m"], r["d"]) == (6, 12, -1.2, "ff", ["a", "1"], "2024-01-01 10:15:00")
    assert (r["large"], r["zero"]) == ((1 << 54) + 2, 0)
    dialect.register(spark)
    assert spark.sql("SELECT to_hex(255) AS h, starts_with('ab', 'a') AS s").first()["h"] == "ff"


SPAN = {
    "name": "chat",
    "traceId": "00112233445566778899aabbccddeeff",
    "kind": "CLIENT",
    "spanId": "a1b2c3d4e5f60718",
    "startTimeUnixNano": "1700000000000000001",
    "parentSpanId": "8877665544332211",
    "endTimeUnixNano": ["1700000000", 43],
    "status": {"message": "done", "code": "OK"},
    "attributes": {"model": "m", "reasons": ["stop", "length"], "gen_ai.input.messages": [{"role": "user"}]},
    "links": [],
    "events": [{"attributes": {"index": 0}, "name": "choice"}],
}


def test_spans():
    id, attrs, contents = importers.span_record(SPAN)
    assert id == f"span/{SPAN['traceId']}/01700000000000000001/a1b2c3d4e5f60718"
    assert [n for n, _ in attrs][-3:] == ["model", "reasons", "reasons"]
    assert contents == {"gen_ai.input.messages": b'[{"role":"user"}]', "otel.events": b'[{"attributes":{"index":0},"name":"choice"}]', "otel.links": b"[]"}
    for bad in ({"traceId": "X" * 32}, {"endTimeUnixNano": 1}, {"spanId": "1"}):
        with pytest.raises(InvalidArgument):
            importers.span_record({**SPAN, **bad})


def test_calls():
    call = {"memberName": "al", "ts": 7, "responseId": "r", "model": "m", "finishReasons": ["stop"], "usage": {"inputTokens": 3}, "attributes": {"z": 1, "a": True}, "inputMessages": [{"x": 1}], "outputMessages": [], "systemInstructions": None}
    got = importers.call_records(call)
    assert [g[0] for g in got] == ["al/0000000000007/r#input"]
    assert [n for n, _ in got[0][1]] == ["gen_ai.request.model", "gen_ai.response.id", "app.member", "app.ts", "gen_ai.response.finish_reasons", "gen_ai.usage.input_tokens", "a", "z", "app.kind"]


def test_json_lines_into_a_store(spark, tmp_path):
    lines = ['{"id":"a","body":"[1,2]","n":1,"f":1.0,"big":18446744073709551615,"o":{},"b":true}', "not json", '{"body":1}', '{"body":"x"}', "", '{"trace_id":"t","kind":"z","body":"[1]"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    rows = importers.jsonl(spark, str(tmp_path / "in.jsonl"))
    assert sorted(r["id"] for r in rows.where("not skipped").collect()) == ["a", "import:000000001", "t:s#z"] and rows.where("skipped").count() == 2
    with Store.open(spark, tmp_path / "s") as s:
        s.ingest(rows.where("not skipped").select("id", "attrs", "body"))
        assert s.read_content("a") == b"[1,2]"
        assert dict(s.get("a").attrs) == {"id": Value.str("a"), "n": Value.int(1), "f": Value.float(1.0), "big": Value.float(2.0**64), "b": Value.bool(True)}
        assert s.dedup["pieces"] == 4 and s.dedup["dedup_hits"] == 1


def test_stream(spark, tmp_path):
    from recordloom.streaming.ingest import into

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","body":"[1]","ts":1}\n{"id":"a","body":"[2]","ts":2}\n{"id":"b","body":null,"ts":1}\n')
    with Store.open(spark, tmp_path / "s") as s:
        stream = spark.readStream.schema("id string, body string, ts long").json(str(tmp_path / "in"))
        into(s, stream, str(tmp_path / "ck"), once=True).awaitTermination()
        assert s.read_content("a") == b"[2]" and s.exists("b") and len(s.commit.parts) == 1


def test_exporter_cadence(spark, tmp_path):
    with Store.open(spark, tmp_path / "s") as s:
        x = importers.SpanExporter(s, flush_spans=3, flush_seconds=1e9)
        spans = [{**SPAN, "spanId": f"{k:016x}"} for k in range(4)]
        x.export(spans[:2])
        assert not s.commit.parts and s.files.exists("_staged.json") and len(s.scan_ids()) == 2
        x.export(spans[2:3])
        assert len(s.commit.parts) == 1
        with pytest.raises(InvalidArgument):
            x.export([spans[3], {**SPAN, "traceId": "?"}])
        assert len(s.scan_ids()) == 3
        x.export(spans[3:])
        x.shutdown()
        assert len(s.commit.parts) == 2 and s.read_content(s.scan_ids()[0], "otel.links") == b"[]"
