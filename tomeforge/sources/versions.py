"""Tables in numbered parts that are written once: a version holds only the parts that changed in it.

    folder/<table>/v=<version>/part=<n>/*.parquet
    folder/manifest/<version>.json      which version each part of each table is read from

A version exists when its manifest does, which is made under another name and then renamed; of two
writers that start from the same version one is refused. So a reader sees whole versions only, and what
a lost driver has left is never read. The number of parts is a parameter of the table, not of its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files that a task writes at once at most; of more parts the rest are sorted.
OPEN_FILES = 256


class Conflict(RuntimeError):
    """Another writer has made the version."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, path: str) -> list[str]:
        where = self._path(path)
        store = where.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []

    def write_text(self, path: str, text: str) -> None:
        """A file that isn't there yet, whole or not at all; Conflict if it is."""
        jvm, waiting = self._jvm, f"{path}.{uuid.uuid4().hex}.waiting"
        out = self._path(waiting).getFileSystem(self._conf).create(self._path(waiting))
        out.write(bytearray(text.encode()))
        out.close()
        store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(waiting).toUri(), self._conf)
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        try:
            store.rename(self._path(waiting), self._path(path), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            store.delete(self._path(waiting), False)
            if "already" in str(e) or "exists" in str(e):
                raise Conflict(path) from e
            raise

    def read_text(self, path: str) -> str:
        where = self._path(path)
        stream = where.getFileSystem(self._conf).open(where)
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def number(self) -> int:
        """The newest version; 0 if there is none."""
        return max((int(n.split(".")[0]) for n in self._listed(f"{self.folder}/manifest") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.number() if version is None else version
        return json.loads(self.read_text(f"{self.folder}/manifest/{version:08}.json")) if version else {"version": 0, "tables": {}}

    def read(self, table: str, parts: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or only some parts of it, with the column `part`."""
        held = self.manifest(version)["tables"][table]
        where = [f"{self.folder}/{table}/v={v}/part={p}" for p, v in held["parts"].items() if parts is None or int(p) in parts]
        schema = StructType.fromJson(held["schema"])
        if not where:
            return self.spark.createDataFrame([], schema)
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/part=(\d+)/", 1).cast("int")
        inside = StructType([f for f in schema if f.name != "part"])
        return self.spark.read.schema(inside).format(held["format"]).load(where).select(*inside.names, number.alias("part"))

    @contextmanager
    def _open_files(self) -> Iterator[None]:
        """Inside, a task keeps the files of up to OPEN_FILES parts open instead of sorting its rows by part."""
        name = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, OPEN_FILES)
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    @staticmethod
    def _stored(rows: DataFrame, kind: str) -> list[str]:
        """The columns that are written: of text tables `value` alone, whatever they are ordered by."""
        return ["value", "part"] if kind == "text" else [*(c for c in rows.columns if c != "part"), "part"]

    def commit(self, tables: dict[str, tuple[DataFrame | Callable, list[int] | None, list[str]]], based_on: int, more: dict | Callable | None = None, kind: str = "parquet") -> int:
        """The next version: of each table the new rows of some parts (all: None), which replace the parts, sorted by some columns.

        Rows have an int column `part`. They are spread by ranges of part and order, so that a large part is
        many files; with no `order` each task writes the rows that it has, as they come, into files of their parts. `kind` is parquet, or text for lines of a column `value`. A function instead of rows gets the new rows of the tables before it, read from where they were written;
        one instead of `more`, which the manifest says besides, gets those of all tables.
        """
        version = based_on + 1
        if self.number() != based_on:
            raise Conflict(f"version {self.number()} is newer than {based_on}")
        held = self.manifest(based_on)["tables"] if based_on else {}
        held = {name: held[name] for name in held}
        done: dict[str, DataFrame] = {}
        for name, (rows, parts, order) in tables.items():
            rows = rows(done) if callable(rows) else rows
            place = f"{self.folder}/{name}/v={version}-{uuid.uuid4().hex[:8]}"  # another writer's rows lie elsewhere
            if order:
                rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order).select(*self._stored(rows, kind)).write.partitionBy("part").format(kind).save(place)
            else:
                with self._open_files():
                    rows.select(*self._stored(rows, kind)).write.partitionBy("part").format(kind).save(place)
            made = [int(n[5:]) for n in self._listed(place) if n.startswith("part=")]
            if parts is not None and not set(made) <= set(parts):
                raise ValueError(f"{name}: rows of parts that aren't replaced")
            old = held.get(name, {"parts": {}})["parts"]
            kept = {p: v for p, v in old.items() if parts is not None and int(p) not in parts}
            stamp = place.rsplit("v=", 1)[1]
            schema = StructType([rows.schema[c] for c in self._stored(rows, kind)])
            done[name] = self.spark.read.schema(schema).format(kind).load(place) if made else self.spark.createDataFrame([], schema)
            held[name] = {"parts": kept | {str(p): stamp for p in made}, "schema": schema.jsonValue(), "format": kind}
        self.write_text(f"{self.folder}/manifest/{version:08}.json", json.dumps({"version": version, "tables": held} | ((more(done) if callable(more) else more) or {})))
        return version
