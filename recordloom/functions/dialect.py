"""Functions other SQL engines have and Spark spells differently or lacks, as
compositions of built-in expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def date_bin(micros: int, ts: Column, origin_micros: int = 0) -> Column:
    """Start of the ``micros``-wide bin that holds a timestamp."""
    at = F.unix_micros(ts.cast("timestamp")) - F.lit(origin_micros)
    return F.timestamp_micros(at - F.pmod(at, F.lit(micros)) + F.lit(origin_micros))


def trunc_number(x: Column, digits: int = 0) -> Column:
    """Towards zero at a number of decimal digits."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def is_zero(x: Column) -> Column:
    return x == F.lit(0)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def strpos(text: Column, part: Column | str) -> Column:
    return F.instr(text, part)


def starts_with(text: Column, part: Column) -> Column:
    return F.startswith(text, part)


def ends_with(text: Column, part: Column) -> Column:
    return F.endswith(text, part)


def regexp_match(text: Column, pattern: str) -> Column:
    """Groups of the first match as an array (the match itself without groups)."""
    import re

    n = re.compile(pattern).groups
    groups = F.array(*(F.regexp_extract(text, pattern, i) for i in (range(1, n + 1) if n else [0])))
    return F.when(F.regexp_like(text, F.lit(pattern)), groups)


def string_to_array(text: Column, by: str) -> Column:
    import re

    return F.split(text, re.escape(by))


def array_resize(a: Column, n: int, fill: Column) -> Column:
    return F.when(F.size(a) >= n, F.slice(a, 1, n)).otherwise(F.concat(a, F.array_repeat(fill, F.lit(n) - F.size(a))))


def nanvl(x: Column, y: Column) -> Column:
    return F.nanvl(x, y)


#: The same as SQL functions, for a caller's session.
SQL = {
    "iszero(x DOUBLE) RETURNS BOOLEAN": "x = 0",
    "to_hex(x BIGINT) RETURNS STRING": "lower(hex(x))",
    "starts_with(s STRING, p STRING) RETURNS BOOLEAN": "startswith(s, p)",
    "ends_with(s STRING, p STRING) RETURNS BOOLEAN": "endswith(s, p)",
    "strpos(s STRING, p STRING) RETURNS INT": "instr(s, p)",
}


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps as a fold; 92 suffice for 64 bits."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] == 0, s["x"]).otherwise(F.try_mod(s["x"], s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    """In whole numbers throughout; zero if either is."""
    part = F.call_function("div", F.abs(a.cast("long")), F.nullif(gcd(a, b), F.lit(0).cast("long")))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(part * F.abs(b.cast("long")))


def register(spark: SparkSession) -> None:
    """Creates the SQL functions for a session."""
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
