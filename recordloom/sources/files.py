"""A store's folder on any file system that Hadoop knows (``file:``, ``hdfs:``,
``s3a:`` …). The driver lists, renames, and reads and writes small files; what grows
with the data (digests, copies) is done file by file in executors."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

STEP = 1 << 20


class Files:
    def __init__(self, spark: SparkSession, root: Any):
        sc = spark.sparkContext
        self.spark, self._hadoop = spark, sc._jvm.org.apache.hadoop.fs
        self._conf, self._io = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.commons.io.IOUtils
        path = self._hadoop.Path(str(root))
        self._fs = path.getFileSystem(self._conf)
        self.root = _uri(self._fs.makeQualified(path).toString().rstrip("/"))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str) -> Any:
        return self._hadoop.Path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def _put(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file that isn't there yet; false if it is."""
        try:
            self._put(name, data)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        return True

    def write(self, name: str, data: bytes) -> None:
        """A file whole or not at all: a draft, renamed over what was there."""
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}"
        self._put(draft, data)
        option = self._hadoop.Options.Rename.OVERWRITE
        how = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = option
        self._hadoop.FileContext.getFileContext(self._path(name).toUri(), self._conf).rename(self._path(draft), self._path(name), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, to: Any) -> None:
        """Moves the whole folder to a place that doesn't exist yet."""
        if not self._fs.rename(self._hadoop.Path(self.root), self._hadoop.Path(str(to))):
            raise OSError(f"{self.root} can't be moved to {to}")

    def names(self, pattern: str) -> list[str]:
        """Names that match a glob, relative to the folder, ascending."""
        found = self._fs.globStatus(self._path(pattern)) or []
        return sorted(_uri(x.getPath().toString())[len(self.root) + 1 :] for x in found)

    def sizes(self) -> list[tuple[str, int]]:
        """All files below, with their bytes."""
        walk, out = self._fs.listFiles(self._path(""), True), []
        while walk.hasNext():
            x = walk.next()
            out.append((_uri(x.getPath().toString())[len(self.root) + 1 :], x.getLen()))
        return out

    def free(self) -> int:
        return self._fs.getStatus(self._path("")).getRemaining()

    def digests(self, names: list[str]) -> DataFrame:
        """(name, bytes, digest) of files, read in executors."""
        root = self.root

        def run(name: str) -> tuple[str, int, str]:
            system, base = arrow_system(root)
            h, total = hashlib.sha256(), 0
            with system.open_input_stream(f"{base}/{name}") as f:
                while block := f.read(STEP):
                    h.update(block)
                    total += len(block)
            return name, total, h.hexdigest()

        return self._each(names, run, "name string, bytes long, digest string")

    def copy(self, names: list[str], to: str) -> int:
        """Copies files to another folder, in executors; returns how many."""
        root = self.root

        def run(name: str) -> tuple[str]:
            (source, a), (target, b) = arrow_system(root), arrow_system(to)
            target.create_dir(f"{b}/{name}".rpartition("/")[0], recursive=True)
            with source.open_input_stream(f"{a}/{name}") as f, target.open_output_stream(f"{b}/{name}") as g:
                while block := f.read(STEP):
                    g.write(block)
            return (name,)

        return self._each(names, run, "name string").count()

    def _each(self, names: list[str], f: Callable[[str], tuple], schema: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in f(name)], columns)

        listed = self.spark.createDataFrame([(n,) for n in names], "name string")
        return listed.repartition(max(1, min(len(names), 4 * self.spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def arrow_system(root: str) -> Any:
    """Arrow's file system for a place, and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + root[3:] if root.startswith("s3a:") else root)  # one store, two schemes
