"""Intermediate tables in the folder that all executors share.

That folder is ``spark.checkpoint.dir``. Everything goes under one folder of the
application, which the file system removes when the application ends; what a
``scope`` wrote is removed when it ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application within ``spark.checkpoint.dir``, as a full URI.
    Where the setting is unset a local master gets a temporary folder; a cluster's
    executors couldn't see one, so there it raises."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        sc.setCheckpointDir(at)
    hadoop = sc._jvm.org.apache.hadoop.fs
    place = hadoop.Path(hadoop.Path(at), f"recordloom-{sc.applicationId}")
    system = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if not system.exists(place):
        system.mkdirs(place)
        system.deleteOnExit(place)
    at = system.makeQualified(place).toString().rstrip("/")
    return at if "://" in at or not at.startswith("file:") else "file://" + at[5:]


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A place of its own in the shared folder; nothing is there yet."""
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for own in getattr(_SCOPES, "open", [])[-1:]:
        own.append(at)
    return at


def remove(spark: SparkSession, *places: str) -> None:
    sc = spark.sparkContext
    for at in places:
        place = sc._jvm.org.apache.hadoop.fs.Path(at)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, what: str, at: str | None = None, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and an
    executor lost later loses nothing. ``compression``: other than the session's."""
    spark = df.sparkSession
    at = at or fresh_dir(spark, what)
    df.write.parquet(at, compression=compression)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is removed at the end; a result
    that outlives it needs a place from outside (``written``'s ``at``)."""
    stack = _SCOPES.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        remove(spark, *stack.pop())
