"""Read-only, parameterised SQL over a snapshot's lens.

A query runs in a session of its own where ``records`` (and ``t``) are the lens.
Positional parameters ``$1``… are rewritten, outside of quotes and comments, to
named ones and bound as typed literals, never spliced into the text. The parsed
plan must be a query or an EXPLAIN of one.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..control import Control
from ..errors import Cancelled, Corruption, Erased, InvalidArgument, LoomError, ResourceExhausted
from ..operators.predicates import literal
from ..types import Value

TABLE, ALIAS = "records", "t"
QUERY_BYTES, TOTAL_BYTES = 256 << 20, 1 << 30
BATCH_ROWS = 8192
BATCH_BYTES = 32 << 20

_TOKENS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\$([0-9]+)""", re.S)
#: Logical plans that change something or look outside the records.
_REFUSED = re.compile(r"Command$|^(Create|Drop|Insert|Alter|Set|Show|Cache|Uncache|Replace|Delete|Update|Merge|Truncate|Refresh|Use|Add|Load|Analyze|Describe|Overwrite|Append|Rename|Repair|Comment|Call|Unresolved.*Procedure)")
_ALLOWED_COMMANDS = {"ExplainCommand"}


#: Spark's error classes of values that an expression can't take.
_ASKED = re.compile(r"\[(DIVIDE_BY_ZERO|REMAINDER_BY_ZERO|ARITHMETIC_OVERFLOW|BINARY_ARITHMETIC_OVERFLOW|CAST_\w+|INVALID_\w+|NUMERIC_\w+|DATETIME_\w+|SCALAR_SUBQUERY_TOO_MANY_ROWS)")


class SqlBudget:
    """Bytes that open queries may reserve together, all or nothing each."""

    def __init__(self, limit: int = TOTAL_BYTES):
        if limit < 1:
            raise InvalidArgument("a budget must be positive")
        self.limit, self.reserved, self._lock = limit, 0, threading.Lock()

    def reserve(self, n: int) -> None:
        with self._lock:
            if self.reserved + n > self.limit:
                raise ResourceExhausted("the SQL budget is spent", "sql_budget", self.reserved + n, self.limit)
            self.reserved += n

    def release(self, n: int) -> None:
        with self._lock:
            self.reserved -= n


@dataclass(frozen=True)
class SqlOptions:
    memory_bytes: int = QUERY_BYTES
    control: Control | None = None


def rewrite(sql: str, count: int) -> str:
    """``$n`` to ``:pn``; a number beyond the parameters raises."""

    def one(m: re.Match) -> str:
        if m.group(1) is None:
            return m.group()
        n = int(m.group(1))
        if not 1 <= n <= count:
            raise InvalidArgument(f"parameter ${n} isn't given")
        return f":p{n}"

    return _TOKENS.sub(one, sql)


def guard(spark: SparkSession, sql: str) -> None:
    """Refuses everything but queries."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise InvalidArgument(f"not a query: {str(e).splitlines()[0]}") from e

    def walk(node: Any) -> None:
        name = node.getClass().getSimpleName()
        if name == "ExplainCommand":
            walk(node.logicalPlan())
            return
        if name not in _ALLOWED_COMMANDS and _REFUSED.search(name):
            raise InvalidArgument(f"{name} is not a read-only query")
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)


def configure(spark: SparkSession) -> None:
    """Identifiers as the store has them: double quotes, and case counts."""
    for k, v in {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC"}.items():
        spark.conf.set(k, v)


def register(spark: SparkSession, flat: DataFrame, name: str = TABLE) -> None:
    """The lens as a temporary view in a session of the caller's, joins and own
    functions included."""
    flat.createOrReplaceTempView(name)


class SqlQuery:
    def __init__(self, snapshot: Any, sql: str, params: list[Any] | None = None, options: SqlOptions = SqlOptions(), budget: SqlBudget | None = None):
        if not sql.strip():
            raise InvalidArgument("the query is empty")
        if options.memory_bytes < 1:
            raise InvalidArgument("memory_bytes must be positive")
        self._budget, self._held = budget or SqlBudget(), 0
        self._iterator: Iterator[tuple[bytes, int]] | None = None
        self._tag = f"recordloom-sql-{uuid.uuid4().hex}"
        self._control = options.control or Control()
        self._control.check("sql")
        self._budget.reserve(options.memory_bytes)
        self._held = options.memory_bytes
        try:
            if hasattr(snapshot, "flush"):  # of a writer, what it has staged is seen too
                snapshot = snapshot.snapshot(options.control)
            values = [Value.of(p) for p in params or []]
            text = rewrite(sql, len(values))
            self.session = snapshot.spark.newSession()
            configure(self.session)
            guard(self.session, text)
            own = type(snapshot)
            view = own.__new__(own)
            view.__dict__.update(snapshot.__dict__, spark=self.session)
            flat = view.lens()
            for name in (TABLE, ALIAS):
                register(self.session, flat, name)
            self.df = self.session.sql(text, args={f"p{i}": literal(v) for i, v in enumerate(values, 1)} or None)
        except LoomError:
            self.close()
            raise
        except Exception as e:
            self.close()
            raise failure(e) from e
        self.rows = self.batches = 0

    @property
    def schema(self) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(self.df.schema)

    def schema_ipc(self) -> bytes:
        """A schema-only IPC stream: there before any row, and for empty results."""
        return _ipc(self.schema, [])

    def _pull(self) -> Iterator[tuple[bytes, int]]:
        """Batches as IPC streams, made in executors: no Python object a row."""
        schema = self.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece in bounded(b):
                    piece = pa.Table.from_batches([piece]).rename_columns(schema.names).cast(schema).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array([_ipc(schema, piece.to_batches())], pa.binary()), pa.array([piece.num_rows], pa.int64())], ["ipc", "n"])

        plain = self.df.toDF(*(f"c{i}" for i in range(len(self.df.columns))))  # two columns may have one name
        for r in plain.mapInArrow(run, "ipc binary, n long").toLocalIterator(prefetchPartitions=True):
            yield bytes(r["ipc"]), r["n"]

    def next(self) -> bytes | None:
        """The next batch as a whole IPC stream, None at the end and after it."""
        if self._held == 0:
            return None
        self._control.check("sql")
        if self._iterator is None:
            self._iterator = self._pull()
        context = self.session.sparkContext
        context.addJobTag(self._tag)
        try:
            with self._control.watching(self.session):
                batch = next(self._iterator, None)
        except LoomError:
            self.close()
            raise
        except Exception as e:
            self.close()
            raise failure(e) from e
        finally:
            context.removeJobTag(self._tag)
        if batch is None:
            self.close()
            return None
        self.rows += batch[1]
        self.batches += 1
        return batch[0]

    def explain(self, analyze: bool = False) -> str:
        """The physical plan; with ``analyze`` after a run of it whose result is
        thrown away, with the rows that each operator then put out."""
        if analyze:
            self.df.write.format("noop").mode("overwrite").save()
        return self.df._jdf.queryExecution().executedPlan().toString()

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.next, None)

    def close(self) -> None:
        """Gives the reservation back and cancels what still runs."""
        held, self._held = self._held, 0
        self._budget.release(held)
        if self._iterator is not None:
            self.session.sparkContext.cancelJobsWithTag(self._tag)

    def __del__(self) -> None:
        if getattr(self, "_held", 0):
            self.close()

    @property
    def finished(self) -> bool:
        return self._held == 0


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of at most BATCH_ROWS rows and BATCH_BYTES, unless one row has more."""
    rows = min(BATCH_ROWS, max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1))))
    for i in range(0, batch.num_rows, rows):
        piece = batch.slice(i, rows)
        if piece.nbytes > BATCH_BYTES and piece.num_rows > 1:
            yield from bounded(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.slice(0, piece.num_rows // 2).columns], schema=piece.schema))
            yield from bounded(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.slice(piece.num_rows // 2).columns], schema=piece.schema))
        else:
            yield piece


def failure(e: Exception) -> LoomError:
    """Any exception of a query as one of ours: what the query asks for is wrong, or
    a value it met; stored content is damaged or erased; memory ran out; else a fault
    of the engine."""
    text = str(e)
    head = text.splitlines()[0] if text else type(e).__name__
    if "ERASED:" in text:
        return Erased("a piece was erased")
    if "CORRUPTION:" in text:
        return Corruption("stored content differs from its hash")
    if "cancel" in text.lower() and "tag" in text.lower():
        return Cancelled(head)
    if "OutOfMemory" in text or "_OUT_OF_MEMORY" in text:
        return ResourceExhausted(head, "memory")
    if _ASKED.search(text) or type(e).__name__ in ("AnalysisException", "ParseException", "ArithmeticException", "ArrayIndexOutOfBoundsException", "NumberFormatException", "DateTimeException", "SparkRuntimeException", "IllegalArgumentException") or isinstance(e, ValueError | TypeError):
        return InvalidArgument(head)
    return LoomError(head)


def _ipc(schema: pa.Schema, batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()
