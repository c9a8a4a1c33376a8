"""Data sources by format name: the members of ZIP archives, and the entries of JSON catalogs.

Files are listed and opened by pyarrow's file systems, so a path may be local or a URI of a store that
these know. After register(spark):

    spark.read.format("tomeforge_archives").load(folder)
    members.write.format("tomeforge_archives").mode("append").save(folder)
    spark.read.format("tomeforge_json").option("field", "include").load(folder)

A reader gives the columns of the schema that it is asked for (`.schema("archive string, member string")`),
and unpacks nothing for the others. A folder that is missing is an error; one without files is an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tomeforge.functions.batches import bounded

#: Limits on unpacked bytes of a member and of an archive's members together (fixed values).
MEMBER_BYTES, ARCHIVE_BYTES = 32 << 20, 100 << 20
#: Bytes of files that one partition reads; a larger archive is several partitions. Bytes of a batch of rows.
PARTITION_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 20, 8 << 20, 1000
CHUNK = 1 << 16

MEMBERS = "archive string, position int, member string, bytes bigint, sha256 string, content binary, problem string"
ENTRIES = "file string, position int, entry string, problem string"
LINK = 0o120777 << 16
_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store and the path in it."""
    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        return stores.LocalFileSystem(), path
    store, inside = stores.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return store, inside


@dataclass
class Run(InputPartition):
    """Files, each with the share of its members (part of parts) that this partition reads."""

    files: list[tuple[str, int, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


def runs(path: str, suffixes: tuple[str, ...], partition_bytes: int, split: bool) -> list[Run]:
    """All files below the path, in order: small ones together, large ones in parts."""
    store, inside = opened(path)
    info = store.get_file_info(inside)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(f"missing scope: {path}")
    found = [info] if info.type == stores.FileType.File else store.get_file_info(stores.FileSelector(inside, recursive=True))
    names = sorted((f.path, f.size) for f in found if f.type == stores.FileType.File and f.path.lower().endswith(suffixes) and not re.search(r"(^|/)[._]", f.path[len(inside) :]))
    out, held = [Run([])], 0
    for name, size in names:
        parts = max(1, -(-size // partition_bytes)) if split else 1
        for part in range(parts):
            if out[-1].files and held + size / parts > partition_bytes:
                out.append(Run([]))
                held = 0
            out[-1].files.append((name, part, parts))
            held += size / parts
    return [r for r in out if r.files]


class _Batches:
    """Rows of the wanted columns, given as record batches of a bounded size."""

    def __init__(self, schema: StructType):
        self.names = [f.name for f in schema]
        self.schema = pa.schema([(f.name, _KINDS[f.dataType.simpleString()]) for f in schema])
        self.rows: list[dict] = []
        self.size = 0

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        self.rows.append({n: row.get(n) for n in self.names})
        self.size += 100 + len(row.get("content") or b"") + len(row.get("entry") or "")
        if self.size >= BATCH_BYTES or len(self.rows) >= BATCH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.size = [], 0


def _known(asked: StructType, all_: str) -> StructType:
    """The asked columns, which must be among those that the source has."""
    kinds = dict(x.split() for x in all_.split(", "))
    for field in asked:
        if kinds.get(field.name) != field.dataType.simpleString():
            raise ValueError(f"no column {field.name} {field.dataType.simpleString()}: there are {all_}")
    return asked


def unsafe(name: str) -> bool:
    """Whether a member's name leads out of the folder that it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return not parts[0] or ".." in parts or ":" in parts[0]


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, options: dict):
        self.schema, self.path = _known(schema, MEMBERS), path
        self.limits = int(options.get("memberBytes", MEMBER_BYTES)), int(options.get("archiveBytes", ARCHIVE_BYTES))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        return runs(self.path, (".zip",), self.partition_bytes, split=True) or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        out, store = _Batches(self.schema), opened(self.path)[0]
        for name, part, parts in partition.files:
            for row in self._members(store, name, part, parts):
                yield from out.add(row | {"archive": name.rsplit("/", 1)[-1]})
        yield from out.rest()

    def _members(self, store: stores.FileSystem, name: str, part: int, parts: int) -> Iterator[dict]:
        try:
            with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                members = [m for m in archive.infolist() if not m.is_dir()]
                whole = sum(m.file_size for m in members) > self.limits[1]
                packed = sum(m.compress_size + 64 for m in members)  # 64: a member without bytes has a share as well
                before = 0
                for position, m in enumerate(members):
                    mine = before * parts // max(1, packed) == part
                    before += m.compress_size + 64
                    if mine:
                        yield {"position": position, "member": m.filename, "bytes": m.file_size} | self._member(archive, m, whole)
        except (zipfile.BadZipFile, EOFError, pa.ArrowInvalid):
            if part == 0:
                yield {"problem": "unreadable"}

    def _member(self, archive: zipfile.ZipFile, m: zipfile.ZipInfo, whole: bool) -> dict:
        if unsafe(m.filename):
            return {"problem": "unsafe_path"}
        if m.external_attr >> 16 & 0o170000 == 0o120000:
            return {"problem": "symlink"}
        if whole or m.file_size > self.limits[0]:
            return {"problem": "too_large"}
        names = self.schema.names
        if "content" not in names and "sha256" not in names:
            return {}
        try:
            digest, kept = hashlib.sha256(), []
            with archive.open(m) as data:
                while chunk := data.read(CHUNK):
                    digest.update(chunk)
                    if "content" in names:
                        kept.append(chunk)
            return {"sha256": digest.hexdigest(), "content": b"".join(kept) if "content" in names else None}
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError):
            return {"problem": "unreadable_member"}  # damaged, encrypted or packed in an unknown way


@dataclass
class Written(WriterCommitMessage):
    """Archives of a task, by name, and where they lie until the commit."""

    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """Archives of rows (archive, member, content[, link]); the rows of an archive must come together, see write_archives()."""

    def __init__(self, schema: StructType, path: str, overwrite: bool, suffix: str):
        if not {"archive", "member", "content"} <= set(schema.names):
            raise ValueError("an archive's rows have the columns archive, member and content")
        self.path, self.overwrite, self.suffix, self.job = path, overwrite, suffix, uuid.uuid4().hex

    def _waiting(self, inside: str) -> str:
        return f"{inside}/_temporary-{self.job}"

    def write(self, rows: Iterator) -> Written:
        store, inside = opened(self.path)
        done: list[tuple[str, str]] = []
        archive = file = None

        def close() -> None:
            if archive is not None:
                archive.close()
                file.close()

        folder = f"{self._waiting(inside)}/{uuid.uuid4().hex}"  # each attempt of a task has its own
        store.create_dir(folder, recursive=True)
        try:
            for row in rows:
                if unsafe(row.archive) or "/" in row.archive:
                    raise ValueError(f"not a name of an archive: {row.archive}")
                if not done or done[-1][0] != row.archive:
                    close()
                    if row.archive in (name for name, _ in done):
                        raise ValueError(f"the rows of {row.archive} don't come together")
                    done.append((row.archive, f"{folder}/{row.archive}{self.suffix}"))
                    file = store.open_output_stream(done[-1][1])
                    archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                m = zipfile.ZipInfo(row.member)  # the same rows make the same bytes: no time of writing
                m.compress_type = zipfile.ZIP_DEFLATED
                m.external_attr = LINK if "link" in row and row.link else 0o644 << 16
                archive.writestr(m, bytes(row.content or b""))
        finally:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, inside = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for name, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an archive's rows are in more than one task")
        if self.overwrite:
            for info in store.get_file_info(stores.FileSelector(inside)):
                if info.type == stores.FileType.File and info.path.endswith(self.suffix):
                    store.delete_file(info.path)
        for name, waiting in files:
            store.move(waiting, f"{inside}/{name}{self.suffix}")
        store.delete_dir(self._waiting(inside))

    def abort(self, messages: list[Written | None]) -> None:
        store, inside = opened(self.path)
        if store.get_file_info(self._waiting(inside)).type == stores.FileType.Directory:
            store.delete_dir(self._waiting(inside))


class Archives(DataSource):
    """Members of ZIP files. `problem`: unreadable (the archive), unsafe_path, symlink, too_large (over memberBytes, or in an archive over archiveBytes), or unreadable_member.

    Rows with a problem have neither sha256 nor content. Sizes are those of the archive's directory and are
    checked before anything is unpacked; whether a member can be unpacked shows only where sha256 or content is asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "tomeforge_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(schema, self.options["path"], self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(schema, self.options["path"], overwrite, self.options.get("suffix", ".zip"))


def entries(chunks: Iterator[str], field: str | None) -> Iterator[tuple[str | None, str | None]]:
    """(entry, problem) of a JSON text that comes in chunks: an array's elements, or the one value there is.

    With `field` the text is an object, and the entries are the elements of the array that it has there.
    An element is decoded when it is complete, so that no more of the text is held than one of them.
    What can't be read gives a last row with the problem; the elements before it are kept.
    """
    decoder, buffer, at, ended = json.JSONDecoder(), "", 0, False

    def more() -> bool:
        """Twice as much text as is left, so that a long element is tried few times."""
        nonlocal buffer, at, ended
        wanted = max(CHUNK, len(buffer) - at)
        parts, at = [buffer[at:]], 0
        while wanted > 0 and not ended:
            part = next(chunks, None)
            ended = part is None
            parts.append(part or "")
            wanted -= len(part or "")
        buffer = "".join(parts)
        return not ended

    def peek() -> str:
        """The next character that isn't white space; empty at the end."""
        nonlocal at
        while True:
            while at < len(buffer) and buffer[at] in " \t\r\n":
                at += 1
            if at < len(buffer):
                return buffer[at]
            if ended:
                return ""
            more()

    def value() -> str | None:
        """The next whole value as it is written; none if there is no valid one."""
        nonlocal at
        peek()
        while True:
            try:
                _, end = decoder.raw_decode(buffer, at)
                if end < len(buffer) or ended:  # a number may go on in the next chunk
                    found, at = buffer[at:end], end
                    return found
            except (json.JSONDecodeError, RecursionError):
                if ended:
                    return None
            more()

    def elements() -> Iterator[tuple[str | None, str | None]]:
        nonlocal at
        at += 1
        if peek() == "]":
            at += 1
            return
        while True:
            found = value()
            if found is None:
                yield None, "unreadable"
                return
            yield found, None
            mark = peek()
            at += 1
            if mark == "]":
                return
            if mark != ",":
                yield None, "unreadable"
                return

    first = peek()
    if field is not None:
        if first != "{":
            yield None, "no_object"
            return
        at += 1
        while peek() == '"':
            key = value()
            if key is None or peek() != ":":
                break
            at += 1
            if json.loads(key) == field:
                if peek() != "[":
                    yield None, "no_array"
                else:
                    yield from elements()
                return
            if value() is None or peek() != ",":
                break
            at += 1
        yield None, "no_field" if peek() == "}" else "unreadable"
    elif first == "[":
        yield from elements()
    else:
        found = value()
        yield (found, None) if found is not None and not peek() else (None, "unreadable")


class JsonReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, options: dict):
        self.schema, self.path, self.field = _known(schema, ENTRIES), path, options.get("field")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        return runs(self.path, (".json", ".txt"), self.partition_bytes, split=False) or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        out, store = _Batches(self.schema), opened(self.path)[0]
        for name, _, _ in partition.files:
            with store.open_input_stream(name) as file:
                decode = codecs.getincrementaldecoder("utf-8-sig")("strict").decode  # a byte order mark is skipped

                def chunks(file=file, decode=decode) -> Iterator[str]:
                    while data := file.read(CHUNK):
                        yield decode(data)
                    yield decode(b"", True)

                position = -1
                try:
                    for position, (entry, problem) in enumerate(entries(chunks(), self.field)):  # noqa: B007
                        yield from out.add({"file": name[len(opened(self.path)[1]) :].lstrip("/"), "position": position, "entry": entry, "problem": problem})
                except UnicodeDecodeError:
                    yield from out.add({"file": name[len(opened(self.path)[1]) :].lstrip("/"), "position": position + 1, "problem": "not_utf8"})
        yield from out.rest()


class JsonCatalogs(DataSource):
    """Entries of JSON files (.json, .txt), as they are written there; `problem`: unreadable, not_utf8, no_object, no_field or no_array."""

    @classmethod
    def name(cls) -> str:
        return "tomeforge_json"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonReader(schema, self.options["path"], self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
    spark.dataSource.register(JsonCatalogs)


def write_archives(rows: DataFrame, path: str) -> None:
    """One ZIP file for each `archive`, members in order of their names; an archive is written by one task, member by member."""
    register(rows.sparkSession)
    bounded(rows.sparkSession)  # the writer is given few members at once
    rows.repartition("archive").sortWithinPartitions("archive", "member").write.format("tomeforge_archives").mode("append").save(path)


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tomeforge_archives").options(**options).load(path)


def catalog_of_members(found: DataFrame, known: DataFrame) -> DataFrame:
    """Readable members with the source that they repeat: one of `known` (id, sha256), else the first member of that content.

    `id` is the content's, `duplicate_of` null for the first member of a content that isn't known.
    """
    place = F.struct("archive", "position")
    good = found.where("problem is null").withColumn("id", F.concat(F.lit("src-"), F.substring("sha256", 1, 16)))
    first = good.groupBy("sha256").agg(F.min(place).alias("first"))
    earlier = known.groupBy("sha256").agg(F.min("id").alias("known_id"))
    rows = good.join(first, "sha256").join(earlier, "sha256", "left")
    other = F.coalesce("known_id", F.when(place != F.col("first"), F.col("id")))
    return rows.select("archive", "position", "member", "id", "sha256", "bytes", other.alias("duplicate_of"))
