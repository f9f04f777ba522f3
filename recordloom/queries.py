"""The engine's operators as queries over the test tables, each with the SQL that
gives the same rows. Record semantics are laid over plain tables: events are versions
(id user_id, sequence event_id, ``error`` deletes), orders and documents are records,
conversations are bodies that grow by a turn at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import types as RT
from .functions import dialect
from .operators import content, introspect, predicates, resolve
from .operators.content import Carve
from .plans import lens
from .sources import importers
from .types import Value

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("tomb", F.col("event_type") == "error")


_NEWEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"
_EVENT = ["user_id", "event_id", "event_type"]

# version resolution


@query(f"SELECT user_id, event_id, event_type, value FROM ({_NEWEST}) WHERE rn = 1")
def resolve_newest_wins(spark, d):
    return resolve.newest(_t(spark, d, "events"), "user_id", "event_id").select(*_EVENT, "value")


@query(f"SELECT user_id, event_id, event_type FROM ({_NEWEST}) WHERE rn = 1 AND event_type <> 'error'")
def resolve_tombstones(spark, d):
    return resolve.live(_versions(spark, d), "user_id", "event_id").select(*_EVENT)


@query(f"SELECT event_type, count(*) AS n FROM ({_NEWEST}) WHERE rn = 1 AND event_type <> 'error' GROUP BY 1")
def resolve_live_by_type(spark, d):
    return resolve.live(_versions(spark, d), "user_id", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""SELECT (SELECT count(*) FROM events) AS physical_rows, (SELECT count(*) - count(DISTINCT user_id) FROM events) AS superseded_rows,
 (SELECT count(*) FROM ({_NEWEST}) WHERE rn = 1 AND event_type = 'error') AS tombstones, (SELECT count(*) FROM ({_NEWEST}) WHERE rn = 1 AND event_type <> 'error') AS live_rows""")
def resolve_stats(spark, d):
    return resolve.statistics(_versions(spark, d), "user_id", "event_id")


@query(f"SELECT user_id, event_id FROM ({_NEWEST}) WHERE rn = 1 AND event_type = 'click'")
def predicate_after_visibility(spark, d):
    return resolve.live(_versions(spark, d), "user_id", "event_id").where("event_type = 'click'").select("user_id", "event_id")


@query(f"SELECT user_id AS id, event_type FROM ({_NEWEST}) WHERE rn = 1")
def overlay_read_your_writes(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    cut = e.agg((F.max("seq") * 0.9).cast("long").alias("cut"))
    marked = e.join(F.broadcast(cut), how="cross")  # one row
    both = resolve.overlay(marked.where("seq < cut").drop("cut"), marked.where("seq >= cut").drop("cut"))
    return resolve.newest(both).select("id", "event_type")


# scans and paging


def _orders(spark, d):
    return _t(spark, d, "orders").withColumn("id", F.format_string("%012d", "o_orderkey"))


_OID = "printf('%012d', o_orderkey)"


@query("SELECT printf('conv/%08d/%04d', conv_id, turn) AS id, role FROM conversations WHERE printf('conv/%08d/%04d', conv_id, turn) LIKE 'conv/0000001%'")
def scan_prefix(spark, d):
    c = _t(spark, d, "conversations").withColumn("id", F.format_string("conv/%08d/%04d", "conv_id", "turn"))
    from .operators.scan import prefix_upper_bound

    return resolve.bounded(c, "conv/0000001", prefix_upper_bound("conv/0000001")).select("id", "role")


# predicates


def _order_records(spark, d):
    o = _orders(spark, d)
    typed = importers.attributes(o, {"o_totalprice": "float", "o_custkey": "int", "o_orderstatus": "str"})
    return typed.select("id", "attrs", RT.no_contents().alias("contents"))


def _register_comparisons() -> None:
    for op, sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):

        def run(spark, d, op=op):
            return _order_records(spark, d).where(predicates.Attr("o_custkey", op, Value.int(300)).column()).select("id")

        run.__name__ = f"pred_attr_{op}"
        query(f"SELECT {_OID} AS id FROM orders WHERE o_custkey {sign} 300")(run)


_register_comparisons()


@query(f"SELECT {_OID} AS id FROM orders WHERE o_totalprice > 250000.5 AND o_orderstatus = 'F' AND {_OID} >= '000000001000'")
def pred_conjunction(spark, d):
    p = [predicates.Attr("o_totalprice", "gt", Value.float(250000.5)), predicates.Attr("o_orderstatus", "eq", Value.str("F")), predicates.Id("gte", "000000001000")]
    return _order_records(spark, d).where(predicates.conjunction(p)).select("id")


@query("SELECT 'float' AS literal, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'int', count(*) FROM orders WHERE o_custkey >= 5 UNION ALL SELECT 'uint', 0")
def pred_no_coercion(spark, d):
    """An integer attribute never matches a literal of another type, whatever its value."""
    o = _order_records(spark, d)
    literals = {"float": Value.float(5.0), "int": Value.int(5), "uint": Value.uint(5)}
    return o.select(*(F.count_if(predicates.Attr("o_custkey", "gte", v).column()).alias(k) for k, v in literals.items())).unpivot([], list(literals), "literal", "n")


@query("SELECT doc_id AS id FROM documents ANTI JOIN labels USING (doc_id)")
def pred_attr_missing(spark, d):
    return _labelled(spark, d).where(predicates.AttrExists("quality", False).column()).select(F.col("id").cast("long"))


@query("SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
def pred_null_vs_missing(spark, d):
    """toxic = 0 is kept as an explicit null, which isn't a missing attribute."""
    return _labelled(spark, d).where(predicates.Attr("toxic", "eq", Value.null()).column()).select(F.col("id").cast("long"))


@query("SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def pred_content_exists(spark, d):
    return _labelled(spark, d).where(predicates.ContentExists("body").column()).select(F.col("id").cast("long"))


def _labelled(spark, d) -> DataFrame:
    x = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality").isNotNull(), RT.attr("quality", "int", F.col("quality")))
    toxic = F.when(F.col("toxic") == 0, RT.attr("toxic", "null")).when(F.col("toxic") == 1, RT.attr("toxic", "bool", F.lit(True)))
    body = F.struct(F.lit("body").alias("name"))
    return x.select(F.col("doc_id").cast("string").alias("id"), F.filter(F.array(quality, toxic), lambda a: a.isNotNull()).alias("attrs"), F.when(F.col("quality") == 1, F.array(body)).otherwise(F.array().cast("array<struct<name:string>>")).alias("contents"))


@query("SELECT * FROM (VALUES (0, false), (1, true), (2, false), (3, false)) t(k, equal)")
def pred_float_bits(spark, d):
    """Equality of floats is by bits: 0.0 is not -0.0, and NaN has no order."""
    x = spark.createDataFrame([(0, -0.0), (1, 0.0), (2, 1.5), (3, float("nan"))], "k int, v double")
    r = x.select("k", F.array(RT.attr("f", "float", F.col("v"))).alias("attrs"))
    return r.select("k", predicates.Attr("f", "eq", Value.float(0.0)).column().alias("equal"))


# lens and projection


def _event_records(spark, d) -> DataFrame:
    e = importers.attributes(_t(spark, d, "events"), {"event_type": "str", "value": "float", "user_id": "int"})
    return e.select(F.col("event_id").cast("string").alias("id"), "attrs", RT.no_contents().alias("contents"))


_EVENT_SCHEMA = introspect.Schema((("event_type", ("str",)), ("user_id", ("int",)), ("value", ("float",))), ())


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type, user_id, value FROM events")
def lens_flat(spark, d):
    return lens.flat(_event_records(spark, d), _EVENT_SCHEMA)


@query("SELECT event_type, count(*) AS n, CAST(round(sum(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1")
def lens_aggregate(spark, d):
    """Catalyst narrows the record to the two attributes asked for."""
    return lens.flat(_event_records(spark, d), _EVENT_SCHEMA).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * 100)).cast("long").alias("cents"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN event_type END AS text, CASE WHEN event_id % 2 = 1 THEN user_id END AS number FROM events")
def lens_mixed_types(spark, d):
    e = _t(spark, d, "events")
    a = F.when(F.col("event_id") % 2 == 0, RT.attr("v", "str", F.col("event_type"))).otherwise(RT.attr("v", "int", F.col("user_id")))
    r = e.select(F.col("event_id").cast("string").alias("id"), F.array(a).alias("attrs"), RT.no_contents().alias("contents"))
    flat = lens.flat(r, introspect.Schema((("v", ("str", "int")),), ()))
    return flat.select("id", F.col("`v#str`").alias("text"), F.col("`v#int`").alias("number"))


@query("SELECT * FROM (VALUES ('event_type', 0), ('user_id', 1), ('value', 2)) t(name, tag)")
def schema_discovery(spark, d):
    return introspect.attribute_types(_event_records(spark, d)).select("name", F.col("tag").cast("int").alias("tag"))


def _tagged(spark, d) -> DataFrame:
    """Orders with their lines' ship flags as a repeated attribute."""
    flags = F.transform(F.array_sort(F.collect_list("l_returnflag")), lambda f: RT.attr("flag", "str", f))
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(flags.alias("attrs"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(count(*) - 1 AS INTEGER) AS duplicates FROM lineitem GROUP BY 1")
def duplicate_attr_count(spark, d):
    return introspect.duplicate_occurrences(_tagged(spark, d))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, min(l_returnflag) AS first_flag, count(*) AS occurrences FROM lineitem GROUP BY 1")
def project_all_occurrences(spark, d):
    r = _tagged(spark, d)
    return r.select("id", predicates.first_occurrence("flag", 0)["s"].alias("first_flag"), F.size(F.filter("attrs", lambda a: a["name"].isin("flag"))).cast("long").alias("occurrences"))


@query("""SELECT 'value' AS name, 2 AS tag, NULL::BIGINT AS least_n, NULL::BIGINT AS greatest_n, min(value) AS least_f, max(value) AS greatest_f, false AS poisoned FROM events
 UNION ALL SELECT 'user_id', 1, CAST(min(user_id) AS BIGINT), CAST(max(user_id) AS BIGINT), NULL, NULL, false FROM events""")
def zone_maps(spark, d):
    z = introspect.zones(_event_records(spark, d))
    return z.withColumns({"tag": F.col("tag").cast("int"), **{c: F.col(c).cast("long") for c in ("least_n", "greatest_n")}})


# content


def _doc_pieces(spark, d, size: int = 1024) -> DataFrame:
    """Documents cut into fixed spans, the caller's own carve."""
    b = _t(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    n = F.octet_length("body")
    spans = F.when(n == 0, F.array().cast("array<struct<foldable:boolean,start:int,len:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda s: F.struct(F.lit(True).alias("foldable"), s.cast("int").alias("start"), F.least(F.lit(size), n - s).cast("int").alias("len")))
    )
    return b.withColumn("spans", spans).withColumn("seq", F.col("doc_id"))


def _fold(carved: DataFrame) -> DataFrame:
    return content.novel(content.pieces(carved), None)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS body_sha256, strlen(coalesce(text, '')) AS len FROM documents")
def reconstruct_bodies(spark, d):
    """Pieces stored once, then every document put together from them and checked."""
    c = _doc_pieces(spark, d)
    programs = c.select("doc_id", content.digest(F.col("body")).alias("identity"), content.ops(F.col("body"), F.col("spans")).alias("ops"))
    out = content.reconstruct(programs, _fold(c), ["doc_id"])
    return out.select("doc_id", F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").cast("long").alias("len"))


@query("SELECT doc_id, sha256(text) AS identity FROM documents")
def content_identity(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.lower(F.hex(content.digest(F.encode("text", "UTF-8")))).alias("identity"))


@query("SELECT doc_id, strlen(text) AS len, CAST(ceil(strlen(text) / 1024.0) AS INTEGER) AS pieces FROM documents")
def content_metadata(spark, d):
    """Metadata comes from the record; the fold isn't read."""
    c = _doc_pieces(spark, d).select("doc_id", content.contents_of(F.lit("body"), F.col("body"), F.col("spans")).alias("c"))
    return c.select("doc_id", F.col("c.len").alias("len"), F.col("c.pieces").alias("pieces"))


@query("SELECT count(text) AS pieces, count(text) - count(DISTINCT text) AS dedup_hits, CAST(sum(strlen(text)) AS BIGINT) AS logical_bytes, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT DISTINCT text, strlen(text) AS n FROM documents)) AS novel_bytes FROM documents WHERE text <> ''")
def whole_dedup(spark, d):
    b = _t(spark, d, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("body"), F.col("doc_id").alias("seq"))
    return content.dedup_metrics(content.pieces(content.carved(b, Carve("whole"))))


def _turns(spark, d) -> DataFrame:
    """The body of a conversation at each turn: a JSON array of the turns so far."""
    c = _t(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.collect_list(F.to_json(F.struct("role", "text"))).over(w)
    return c.select("conv_id", "turn", F.encode(F.concat(F.lit("["), F.array_join(so_far, ","), F.lit("]")), "UTF-8").alias("body")).withColumn("seq", F.col("turn"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS pieces FROM conversations")
def carve_messages(spark, d):
    c = content.carved(_turns(spark, d))
    return c.select("conv_id", "turn", F.size(F.filter("spans", lambda s: s["foldable"])).cast("long").alias("pieces"))


@query("""SELECT (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)) AS pieces,
 (SELECT count(*) FROM (SELECT DISTINCT role, text FROM conversations)) AS distinct_pieces""")
def dedup_ratio(spark, d):
    m = content.dedup_metrics(content.pieces(content.carved(_turns(spark, d))))
    return m.select("pieces", (F.col("pieces") - F.col("dedup_hits")).alias("distinct_pieces"))


@query()
def cdc_chunks(spark, d):
    b = _t(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    c = content.carved(b, Carve("cdc", 1024))
    return c.select("doc_id", F.size("spans").alias("chunks"), F.aggregate("spans", F.lit(0), lambda a, s: a + s["len"]).alias("bytes"))


@query("SELECT DISTINCT sha256(text) AS piece FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def piece_anti_join(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    made = lambda x: x.select(content.digest(F.encode("text", "UTF-8")).alias("piece"), F.octet_length("text").alias("len"), F.encode("text", "UTF-8").alias("bytes"), F.col("doc_id").alias("seq"))
    return content.novel(made(docs), made(docs.where("doc_id % 2 = 0"))).select(F.lower(F.hex("piece")).alias("piece"))


# maintenance


# importers, SQL


@query("SELECT printf('span/%032d/%020d/%016d', user_id, epoch_us(ts) * 1000, event_id) AS id FROM events")
def otel_span_ids(spark, d):
    e = _t(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(importers.span_id(F.format_string("%032d", "user_id"), start, F.format_string("%016d", "event_id")).alias("id"))


@query("SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bin, CAST(gcd(event_id, 360) AS BIGINT) AS g, CAST(lcm(event_id + 1, 12) AS BIGINT) AS l, CAST(lcm(event_id + 9007199254740993, 2) AS BIGINT) AS large FROM events")
def dialect_functions(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", dialect.date_bin(900_000_000, F.col("ts")).cast("timestamp_ntz").alias("bin"), dialect.gcd(F.col("event_id"), F.lit(360)).alias("g"), dialect.lcm(F.col("event_id") + 1, F.lit(12)).alias("l"), dialect.lcm(F.col("event_id") + (1 << 53) + 1, F.lit(2)).alias("large"))


# functions and aggregates whose names or forms differ


@query("SELECT l_returnflag, list_sort(array_agg(DISTINCT l_linestatus)) AS modes, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS states FROM lineitem GROUP BY 1")
def agg_arrays(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_returnflag")
    return g.agg(F.sort_array(F.collect_set("l_linestatus")).alias("modes"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("states"))


@query("SELECT event_type, true AS close_count, true AS close_median FROM events GROUP BY 1")
def agg_approximate(spark, d):
    """Within a tenth of the exact figure, and within two per cent of the exact rank."""
    g = _t(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"), F.percentile_approx("value", 0.5, 1000).alias("m"), F.collect_list("value").alias("v"))
    rank = F.size(F.filter("v", lambda x: x <= F.col("m"))) / F.size("v")
    return g.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("close_count"), (F.abs(rank - 0.5) < 0.02).alias("close_median"))


@query("SELECT doc_id, regexp_extract(source, '([a-z]+)([0-9]+)', 1) AS word, regexp_extract(source, '([a-z]+)([0-9]+)', 2) AS number, regexp_replace(lang, '[aeiou]', '_', 'g') AS masked, regexp_matches(source, '^src1') AS hit FROM documents")
def functions_regex(spark, d):
    m = dialect.regexp_match(F.col("source"), "([a-z]+)([0-9]+)")
    x = _t(spark, d, "documents")
    return x.select("doc_id", F.coalesce(m[0], F.lit("")).alias("word"), F.coalesce(m[1], F.lit("")).alias("number"), F.regexp_replace("lang", "[aeiou]", "_").alias("masked"), F.regexp_like("source", F.lit("^src1")).alias("hit"))


@query("""SELECT c_custkey, list_resize([c_custkey, c_nationkey], 3, -1) AS resized, list_contains([1, 2, 3], c_nationkey) AS has, CAST(list_position([5, 6, 7], c_nationkey) AS INTEGER) AS place,
 list_sort(list_distinct([c_nationkey, 1, c_nationkey, 3])) AS distinct_sorted, [1, 2, 3, 4][2:3] AS part, len(string_split(c_name, '#')) AS pieces, CAST(list_sum([c_nationkey, 2]) AS BIGINT) AS total FROM customer""")
def functions_nested(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = _t(spark, d, "customer")
    return c.select(
        "c_custkey",
        dialect.array_resize(F.array(k.cast("long"), n.cast("long")), 3, F.lit(-1).cast("long")).alias("resized"),
        F.array_contains(F.array(*map(F.lit, (1, 2, 3))), n.cast("int")).alias("has"),
        F.nullif(F.array_position(F.array(*map(F.lit, (5, 6, 7))), n.cast("int")), F.lit(0).cast("long")).cast("int").alias("place"),
        F.sort_array(F.array_distinct(F.array(n.cast("long"), F.lit(1).cast("long"), n.cast("long"), F.lit(3).cast("long")))).alias("distinct_sorted"),
        F.slice(F.array(*map(F.lit, (1, 2, 3, 4))), 2, 2).alias("part"),
        F.size(dialect.string_to_array(F.col("c_name"), "#")).cast("long").alias("pieces"),
        F.aggregate(F.array(n.cast("long"), F.lit(2).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x).alias("total"),
    )


@query("SELECT o_orderkey, CAST(to_hex(o_orderkey) AS VARCHAR) AS hex, starts_with(o_orderpriority, '1') AS first, CAST(strpos(o_orderpriority, '-') AS INTEGER) AS dash, trunc(o_totalprice) AS whole, isnan(o_totalprice) AS nan, o_totalprice = 0 AS zero FROM orders")
def dialect_names(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.upper(dialect.to_hex(F.col("o_orderkey"))).alias("hex"), dialect.starts_with(F.col("o_orderpriority"), F.lit("1")).alias("first"), dialect.strpos(F.col("o_orderpriority"), "-").alias("dash"), dialect.trunc_number(F.col("o_totalprice")).alias("whole"), F.isnan("o_totalprice").alias("nan"), dialect.is_zero(F.col("o_totalprice")).alias("zero"))


# inherited SQL, in one dialect

_PLAIN = {
    "join_inner": ("SELECT o_orderpriority, count(*) AS n, CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS cents FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderpriority", "orders lineitem"),
    "join_left": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "customer orders"),
    "join_right": ("SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey", "nation supplier"),
    "join_full": ("SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) b ON a.k = b.k", "customer supplier"),
    "join_cross_small": ("SELECT r_name, n_name FROM region CROSS JOIN nation", "region nation"),
    "join_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders"),
    "join_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "customer orders"),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation"),
    "join_natural": ("SELECT count(*) AS n FROM documents NATURAL JOIN labels", "documents labels"),
    "join_lateral": ("SELECT n_name, x.c AS customers FROM nation, LATERAL (SELECT count(*) AS c FROM customer WHERE c_nationkey = n_nationkey) x", "nation customer"),
    "join_five_tables": ("SELECT n_name, CAST(round(sum(l_extendedprice * (1 - l_discount) * 100)) AS BIGINT) AS cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'ASIA' GROUP BY n_name", "region nation customer orders lineitem"),
    "agg_pricing": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS cents, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus", "lineitem"),
    "agg_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", "orders"),
    "agg_filter": ("SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, count(DISTINCT user_id) AS users FROM events GROUP BY event_type", "events"),
    "agg_distinct": ("SELECT DISTINCT p_brand, p_size FROM part", "part"),
    "agg_bool_bit": ("SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS every, bool_or(c_acctbal > 9990) AS some, bit_xor(c_custkey) AS x FROM customer GROUP BY c_mktsegment", "customer"),
    "agg_statistics": ("SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(corr(p_size, p_retailprice), 6) AS r, round(regr_slope(p_retailprice, p_size), 4) AS slope FROM part GROUP BY p_brand", "part"),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem"),
    "agg_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders"),
    "agg_grouping_sets": ("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", "part"),
    "window_ranks": ("SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", "customer"),
    "window_distribution": ("SELECT c_custkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)", "customer"),
    "window_lag_lead": ("SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first, nth_value(event_id, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", "events"),
    "window_rows_frame": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS nxt FROM events", "events"),
    "window_range_frame": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM events", "events"),
    "setop_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer supplier"),
    "setop_union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", "nation region"),
    "setop_intersect": ("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'", "lineitem"),
    "setop_except": ("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.095", "part lineitem"),
    "setop_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "customer supplier"),
    "setop_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer supplier"),
    "topk_orders": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders"),
    "topk_per_group": ("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) x WHERE k <= 5", "events"),
    "cte_recursive": ("WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 12) SELECT n, f FROM r", ""),
    "subquery_scalar": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)", "supplier"),
    "subquery_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.9 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders"),
    "subquery_in": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_size < 10", "part lineitem"),
    "values_case": ("SELECT k, CASE WHEN k > 1 THEN coalesce(v, 'none') ELSE nullif(v, 'a') END AS v FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(k, v)", ""),
    "functions_string": ("SELECT doc_id, upper(lang) AS u, length(text) AS n, left(text, 5) AS l, replace(source, 'src', 's') AS r, lpad(lang, 4, '*') AS p, concat_ws('-', lang, source) AS c, md5(text) AS m, reverse(source) AS v, split_part(source, 'c', 2) AS s FROM documents", "documents"),
    "functions_math": ("SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) < 0.02 AS near, CAST(floor(l_quantity) AS BIGINT) AS f, round(sqrt(l_extendedprice), 4) AS s, round(power(l_discount, 2), 8) AS p, CAST(sign(l_tax) AS INT) AS g, l_orderkey % 7 AS m FROM lineitem", "lineitem"),
    "agg_percentiles": ("SELECT l_returnflag, round(median(l_quantity), 6) AS med, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q1, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90, mode() WITHIN GROUP (ORDER BY l_linestatus) AS m FROM lineitem GROUP BY l_returnflag", "lineitem"),
    "agg_covariance": ("SELECT p_brand, round(covar_pop(p_size, p_retailprice), 3) AS cp, round(covar_samp(p_size, p_retailprice), 3) AS cs, round(var_pop(p_retailprice), 3) AS vp, round(var_samp(p_size), 6) AS vs, round(regr_intercept(p_retailprice, p_size), 3) AS ri, round(regr_r2(p_retailprice, p_size), 6) AS r2, regr_count(p_retailprice, p_size) AS rc FROM part GROUP BY p_brand", "part"),
    "agg_first_last": ("SELECT user_id, max_by(event_type, event_id) AS newest, min_by(event_type, event_id) AS oldest, CAST(count_if(value > 50) AS BIGINT) AS big, any_value(user_id) AS u FROM events GROUP BY user_id", "events"),
    "functions_text": ("SELECT p_partkey, trim(concat('  ', p_brand, ' ')) AS t, ltrim(concat(' ', p_brand)) AS lt, rtrim(concat(p_brand, ' ')) AS rt, substr(p_name, 2, 4) AS s, right(p_name, 3) AS r, repeat('ab', 2) AS rp, translate(p_brand, 'Bd', 'bD') AS tr, ascii(p_brand) AS a, chr(65 + p_size % 26) AS c, rpad(p_brand, 12, '.') AS pd, lower(p_name) AS lo, bit_length(p_brand) AS bl, position('#' IN p_brand) AS ps, levenshtein(p_brand, 'Brand') AS lv FROM part", "part"),
    "functions_more_math": ("SELECT o_orderkey, round(ln(o_totalprice), 8) AS l, round(log10(o_totalprice), 8) AS l10, round(log2(o_totalprice), 8) AS l2, round(exp(o_custkey / 1000000.0), 8) AS e, round(sin(o_custkey), 8) AS sn, round(atan2(o_custkey, 3), 8) AS at, round(cbrt(o_totalprice), 6) AS cb, CAST(ceil(o_totalprice) AS BIGINT) AS ce, round(radians(o_custkey), 6) AS ra, CAST(factorial(CAST(o_custkey % 10 AS INT)) AS BIGINT) AS f, o_custkey & 12 AS b_and, o_custkey | 3 AS b_or FROM orders", "orders"),
    "functions_conditional": ("SELECT c_custkey, greatest(c_acctbal, 0) AS g, least(c_nationkey, 7) AS l, nullif(c_mktsegment, 'BUILDING') AS n, coalesce(nullif(c_nationkey, 3), -1) AS c, if(c_acctbal < 0, 'owes', 'has') AS i FROM customer", "customer"),
    "functions_dates": ("SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS ld, make_date(2020, CAST(o_orderkey % 12 + 1 AS INT), 1) AS md, CAST(extract(doy FROM o_orderdate) AS INT) AS doy, CAST(extract(week FROM o_orderdate) AS INT) AS w, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE) AS later FROM orders", "orders"),
    "functions_time": ("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(quarter FROM o_orderdate) AS INT) AS q FROM orders", "orders"),
}


def _register_plain() -> None:
    for name, (sql, tables) in _PLAIN.items():

        def run(spark, d, sql=sql, tables=tables):
            for t in tables.split():
                _t(spark, d, t).createOrReplaceTempView(t)
            return spark.sql(sql)

        run.__name__ = name
        query(sql)(run)


_register_plain()


from . import stored  # noqa: E402 - it uses the tables above

QUERIES |= stored.QUERIES
SQL |= stored.SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Live users by the type of their newest event."""
    return resolve_live_by_type(spark, d)
