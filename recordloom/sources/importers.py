"""Importers: JSON lines, OpenTelemetry spans, and generative-AI calls, to tables
that ``Store.ingest`` and ``Store.write`` take."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..errors import InvalidArgument
from ..types import ATTR, Value, attr, attr_arrays

IMPORTED = T.StructType([T.StructField("line", T.LongType()), T.StructField("id", T.StringType()), T.StructField("attrs", T.ArrayType(ATTR)), T.StructField("body", T.StringType()), T.StructField("skipped", T.BooleanType())])


def _json_value(v: Any) -> Value | None:
    if isinstance(v, bool):
        return Value.bool(v)
    if isinstance(v, int):
        return Value.int(v) if -(1 << 63) <= v < 1 << 63 else Value.float(float(v))
    if isinstance(v, float):
        return Value.float(v)
    return Value.str(v) if isinstance(v, str) else None


def parse_line(text: str) -> tuple[str | None, list[tuple[str, Value]], str] | None:
    """(id, attributes, body) of one JSON line, None if it is skipped: scalars are
    attributes, in name order; the token decides between integer and float, so a
    schema-driven parser won't do."""
    try:
        v = json.loads(text)
        body = v["body"]
    except (ValueError, KeyError, TypeError, IndexError):
        return None
    if not isinstance(body, str):
        return None
    text_of = lambda k, d: v[k] if isinstance(v.get(k), str) else d
    if isinstance(v.get("id"), str):
        id = v["id"]
    elif isinstance(v.get("trace_id"), str):
        id = f"{v['trace_id']}:{text_of('span_id', 's')}#{text_of('kind', 'k')}"
    else:
        id = None
    attrs = [(k, a) for k in sorted(v, key=str.encode) if k != "body" and (a := _json_value(v[k])) is not None]
    return id, attrs, body


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, attrs, body, skipped) of a file of JSON lines, or of a folder of them
    in the order of their names; blank lines are no lines, others count from 0.
    Records without an id get ``import:%09d`` of their place among accepted lines.
    Lines are parsed once, numbered within the split they are read in; the driver adds
    up the splits' counts, so nothing is sorted or moved."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where("trim(value) <> ''")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, k, place = None, 0, 0
        for b in batches:
            files, starts = b.column(1), b.column(2)
            found = [parse_line(x) for x in b.column(0).to_pylist()]
            ks, places = [], []
            for at, r in zip(zip(files.to_pylist(), starts.to_pylist()), found):
                if at != split:
                    split, k, place = at, 0, 0
                ks.append(k)
                places.append(place)
                k, place = k + 1, place + (r is not None)
            columns = [files, starts, pa.array(ks, pa.int64()), pa.array(places, pa.int64()), pa.array([r and r[0] for r in found], pa.string()), attr_arrays([r and r[1] for r in found]), pa.array([r and r[2] for r in found], pa.string()), pa.array([r is None for r in found])]
            yield pa.RecordBatch.from_arrays(columns, ["file", "start", "k", "place", "id", "attrs", "body", "skipped"])

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("k", T.LongType()), T.StructField("place", T.LongType()), *IMPORTED.fields[1:]])
    rows = scratch.written(lines.mapInArrow(parse, schema), "lines", compression="zstd")
    splits, line, place = [], 0, 0
    for r in sorted(rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.count_if(~F.col("skipped")).alias("accepted")).collect()):
        splits.append((r["file"], r["start"], line, place))
        line, place = line + r["n"], place + r["accepted"]
    first = spark.createDataFrame(splits, "file string, start long, line0 long, place0 long")
    named = F.when(~F.col("skipped"), F.coalesce("id", F.format_string("import:%09d", F.col("place0") + F.col("place"))))
    return rows.join(F.broadcast(first), ["file", "start"]).select((F.col("line0") + F.col("k")).alias("line"), named.alias("id"), "attrs", "body", "skipped")


CONTENT_ATTRIBUTES = tuple(f"gen_ai.{x}" for x in ("input.messages", "output.messages", "system_instructions", "tool.definitions"))


_DIGITS = re.compile("[0-9a-f]*")
_TIGHT = (",", ":")
_STABLE = json.JSONEncoder(ensure_ascii=False, separators=_TIGHT, sort_keys=True)


def stable_json(v: Any) -> bytes:
    """Compact JSON with sorted keys."""
    return _STABLE.encode(v).encode()


def time_ns(v: Any) -> int:
    """Nanoseconds from an integer, decimal text, or (seconds, nanoseconds)."""
    if isinstance(v, str):
        return int(v)
    if isinstance(v, tuple | list) and len(v) == 2:
        return int(v[0]) * 1_000_000_000 + int(v[1])
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    raise InvalidArgument("a time is an integer, decimal text, or seconds and nanoseconds")


def span_record(span: Mapping[str, Any]) -> tuple[str, list[tuple[str, Value]], dict[str, bytes]]:
    """(id, attributes, contents) of one normalised span."""

    def digits(key: str, n: int) -> str:
        v = span[key]
        if not isinstance(v, str) or len(v) != n or not _DIGITS.fullmatch(v):
            raise InvalidArgument(f"{key} must be {n} lower-case hexadecimal digits")
        return v

    trace, own = digits("traceId", 32), digits("spanId", 16)
    parent = digits("parentSpanId", 16) if span.get("parentSpanId") else None
    start, end = (time_ns(span[f"{edge}TimeUnixNano"]) for edge in ("start", "end"))
    if not 0 <= start <= end:
        raise InvalidArgument("a span's times must be ordered and not negative")
    attrs = [("otel.trace_id", Value.str(trace)), ("otel.span_id", Value.str(own))]
    attrs += [("otel.parent_span_id", Value.str(parent))] if parent else []
    status = span.get("status") or {}
    attrs += [
        ("otel.name", Value.str(str(span["name"]))),
        ("otel.kind", Value.str(str(span.get("kind", "INTERNAL")))),
        ("otel.start_time_unix_nano", Value.timestamp_ns(start)),
        ("otel.end_time_unix_nano", Value.timestamp_ns(end)),
        ("otel.duration_ns", Value.int(end - start)),
        ("otel.status.code", Value.str(str(status.get("code", "UNSET")))),
    ]
    attrs += [("otel.status.message", Value.str(str(status["message"])))] if status.get("message") else []
    contents: dict[str, bytes] = {}
    given = span.get("attributes") or []
    for name, v in given.items() if isinstance(given, Mapping) else given:
        if name in CONTENT_ATTRIBUTES:
            contents[name] = v.encode() if isinstance(v, str) else stable_json(v)
        elif isinstance(v, tuple | list):
            attrs += [(name, Value.of(x)) for x in v]
        else:
            attrs.append((name, Value.of(v)))
    for key in ("events", "links"):
        if key in span:
            contents[f"otel.{key}"] = stable_json(span[key])
    return f"span/{trace}/{start:020d}/{own}", attrs, contents


def spans(lines: DataFrame) -> DataFrame:
    """(id, attrs, contents) of a table of spans as JSON text (column value), for
    ``Store.ingest``. A span that isn't valid raises."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("attrs", T.ArrayType(ATTR)), T.StructField("contents", T.MapType(T.StringType(), T.BinaryType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [span_record(json.loads(x)) for x in b.column(0).to_pylist()]
            contents = pa.array([list(c.items()) for _, _, c in found], pa.map_(pa.string(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in found], pa.string()), attr_arrays([a for _, a, _ in found]), contents], ["id", "attrs", "contents"])

    return _spread(lines).mapInArrow(parse, schema)


def _spread(lines: DataFrame) -> DataFrame:
    """The texts over all cores, in batches that stay small: a file of few splits would
    leave the parsing to as many tasks."""
    return lines.select("value").repartition(F.xxhash64("value"))


def calls(lines: DataFrame, prefix: str = "app") -> DataFrame:
    """(id, attrs, body) of a table of calls as JSON text (column value): up to three
    records of each."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("attrs", T.ArrayType(ATTR)), T.StructField("body", T.BinaryType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for x in b.column(0).to_pylist() for r in call_records(json.loads(x), prefix)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in found], pa.string()), attr_arrays([a for _, a, _ in found]), pa.array([c for _, _, c in found], pa.binary())], ["id", "attrs", "body"])

    return _spread(lines).mapInArrow(parse, schema)


def span_id(trace: Any, start_ns: Any, span: Any) -> Any:
    """The id of a span row, as a column expression."""
    return F.concat_ws("/", F.lit("span"), trace, F.format_string("%020d", start_ns), span)


_CALL_TEXT = (("gen_ai.operation.name", "operationName"), ("gen_ai.provider.name", "provider"), ("gen_ai.request.model", "model"), ("gen_ai.response.id", "responseId"))
_CALL_USAGE = (("input_tokens", "inputTokens"), ("output_tokens", "outputTokens"), ("cache_read_input_tokens", "cacheReadInputTokens"), ("cache_creation_input_tokens", "cacheCreationInputTokens"))


def call_records(call: Mapping[str, Any], prefix: str = "app") -> list[tuple[str, list[tuple[str, Value]], bytes]]:
    """Up to three records (system, input, output) of one generative-AI call, with
    its attributes in fixed order; ``prefix`` names the deployment's own fields."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    member = call.get("memberName") if isinstance(call.get("memberName"), str) else "unknown"
    ts = call["ts"] if whole(call.get("ts")) else 0
    response = call.get("responseId") if isinstance(call.get("responseId"), str) else "norid"
    base: list[tuple[str, Value]] = []
    for name, key in (*_CALL_TEXT, (f"{prefix}.query_source", "querySource"), (f"{prefix}.agent_name", "agentName")):
        if isinstance(call.get(key), str):
            base.append((name, Value.str(call[key])))
    base += [(f"{prefix}.member", Value.str(member)), (f"{prefix}.ts", Value.int(ts))]
    if whole(call.get("receivedAt")):
        base.append((f"{prefix}.received_at", Value.int(call["receivedAt"])))
    base += [("gen_ai.response.finish_reasons", Value.str(x)) for x in call.get("finishReasons") or [] if isinstance(x, str)]
    usage = call.get("usage") or {}
    base += [(f"gen_ai.usage.{name}", Value.int(usage[key])) for name, key in _CALL_USAGE if whole(usage.get(key))]
    own = call.get("attributes") if isinstance(call.get("attributes"), Mapping) else {}
    base += [(k, Value.of(own[k])) for k in sorted(own) if isinstance(own[k], str | bool | int | float)]
    out = []
    for kind, what in (("system", "Instructions"), ("input", "Messages"), ("output", "Messages")):
        body = call.get(kind + what)
        if body is None or body == []:
            continue
        out.append((f"{member}/{ts:013d}/{response}#{kind}", [*base, (f"{prefix}.kind", Value.str(kind))], stable_json(body)))
    return out


def attributes(table: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """A table's columns as one array of attributes, in the order given; null cells
    are absent."""
    made = [F.when(F.col(c).isNotNull(), attr(c, t, F.col(c))) for c, t in types.items()]
    return table.withColumn("attrs", F.filter(F.array(*made), lambda a: a.isNotNull()))


class SpanExporter:
    """Takes finished spans: every export is durable before it returns, and staged
    spans become a part at ``flush_spans`` of them or after ``flush_seconds``."""

    def __init__(self, store: Any, flush_spans: int = 512, flush_seconds: float = 5.0):
        import time

        self._clock = time.monotonic
        self.store, self.flush_spans, self.flush_seconds = store, flush_spans, flush_seconds
        self._pending, self._since = 0, self._clock()

    def export(self, spans: list[Mapping[str, Any]]) -> int:
        """Maps all spans before it stages any; returns how many were taken."""
        from .store import Batch

        batch = Batch()
        for s in spans:
            id, attrs, contents = span_record(s)
            batch.put(id, attrs, contents)
        self.store.apply(batch)
        self.store.sync()
        self._pending += len(spans)
        if self._pending >= self.flush_spans or self._clock() - self._since >= self.flush_seconds:
            self.force_flush()
        return len(spans)

    def force_flush(self) -> None:
        self.store.flush()
        self._pending, self._since = 0, self._clock()

    def shutdown(self) -> None:
        self.store.sync()
        self.force_flush()
