"""Connected components of an edge list, by alternating large- and small-star
steps: linear edges per round, a logarithmic number of rounds, no hot adjacency
list gathered anywhere (only minima are kept per node). Each round is a table, which
the next one replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove
from . import textkit as T


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long), any direction, repeats and loops allowed.
    Returns (node long, component long): every node of an edge with the smallest
    node it reaches. Null ends are ignored; no edges give no rows."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    nodes = T.written(edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct(), "nodes")
    spark = edges.sparkSession
    at, before, rounds = T.fresh_dir(spark, "edges"), None, 0
    e = T.written(e, "edges", at)
    while True:
        rounds += 1
        # large star: neighbours greater than u go to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        last, at = at, T.fresh_dir(spark, f"edges-of-round-{rounds}")
        e = T.written(small, "edges", at)
        remove(spark, last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    low = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
