"""Files, archives, embedded images and pages as DataFrames, and the sinks."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tomeforge.functions.text import stable_id
from tomeforge.operators.catalog import file_kind


def inventory(spark: SparkSession, scopes: list[tuple[str, str]]) -> DataFrame:
    """All files below each (collection, folder), in order of scopes: content hash, size, kind and id.

    Spark's reader lists the folders, so they can be in any store that it knows; one that is missing
    fails. Content is hashed in the JVM and isn't kept.
    """
    parts = []
    for n, (collection, folder) in enumerate(scopes):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        sha = F.sha2("content", 256)
        parts.append(rows.select(F.lit(n).alias("scope"), F.lit(collection).alias("collection"), "path", F.col("length").alias("bytes"), sha.alias("sha256"), file_kind(F.col("path"), F.substring("content", 1, 3)).alias("kind"), stable_id(sha).alias("id")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def markdown_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(source, page, text) of …/<source>/pages/<number>.md."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    path = F.col("_metadata.file_path")
    found = rows.select(F.regexp_extract(path, r"([^/]+)/pages/[0-9]+\.md$", 1).alias("source"), F.regexp_extract(path, r"/pages/([0-9]+)\.md$", 1).try_cast("int").alias("page"), F.col("value").alias("text"))
    return found.where("page is not null")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object in one file; a byte order mark is skipped."""
    return spark.read.option("multiLine", True).option("encoding", "UTF-8").schema(schema).json(path)


MEMBER_BYTES, ARCHIVE_BYTES = 32 << 20, 100 << 20


def archive_members(archives: DataFrame) -> DataFrame:
    """archives: path, content. (path, member, sha256, bytes, content, problem) of ZIP files.

    problem: too_large for an archive or member over its limit, unsafe_path, symlink, or unreadable; such
    rows have no content. Sizes are checked before anything is unpacked.
    """

    names = ["path", "member", "content", "problem"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    held = zipfile.ZipFile(io.BytesIO(content))
                    members = [m for m in held.infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(path, None, None, "unreadable")], columns=names)
                    continue
                total = sum(m.file_size for m in members)
                for m in members:
                    name = m.filename.replace("\\", "/")
                    if name.startswith("/") or ".." in name.split("/") or ":" in name.split("/")[0]:
                        rows.append((path, m.filename, None, "unsafe_path"))
                    elif m.external_attr >> 16 & 0o170000 == 0o120000:
                        rows.append((path, m.filename, None, "symlink"))
                    elif total > ARCHIVE_BYTES or m.file_size > MEMBER_BYTES:
                        rows.append((path, m.filename, None, "too_large"))
                    else:
                        rows.append((path, m.filename, held.read(m), None))
                yield pd.DataFrame(rows, columns=names)  # one archive at a time

    rows = archives.select("path", "content").mapInPandas(run, "path string, member string, content binary, problem string")
    return rows.select("path", "member", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), "content", "problem")


def data_uri(uri: Column) -> Column:
    """{suffix, content, sha256} of `data:image/png;base64,…`; null for other text."""
    head = r"^data:image/([a-z0-9.+-]+);base64,"
    content = F.unbase64(F.regexp_replace(uri, head, ""))
    return F.when(uri.rlike(head), F.struct(F.regexp_extract(uri, head, 1).alias("suffix"), content.alias("content"), F.sha2(content, 256).alias("sha256")))


IMAGE_BYTES = 8 << 20


def _image(data: bytes | None, declared: str | None) -> dict:
    out = {"type": None, "width": None, "height": None, "problem": None}
    if not data or len(data) > IMAGE_BYTES:
        return out | {"problem": "size"}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at, seen, end = 8, [], False
            while at + 12 <= len(data) and not end:
                size, name = struct.unpack(">I4s", data[at : at + 8])
                seen.append(name)
                end = name == b"IEND"
                at += 12 + size
            if seen[0] != b"IHDR" or b"IDAT" not in seen or not end or at != len(data):
                return out | {"problem": "damaged"}
            width, height = struct.unpack(">II", data[16:24])
            out |= {"type": "image/png", "width": width, "height": height}
        elif data[:3] == b"\xff\xd8\xff":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return out | {"problem": "damaged"}
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    out |= {"type": "image/jpeg", "width": width, "height": height}
                    break
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            width, height = struct.unpack("<HH", data[6:10])
            out |= {"type": "image/gif", "width": width, "height": height}
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                width, height = int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            elif kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                width, height = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            else:
                width, height = (x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
            out |= {"type": "image/webp", "width": width, "height": height}
    except (struct.error, IndexError):
        return out | {"problem": "damaged"}
    if not out["type"] or not out["width"] or not out["height"]:
        return out | {"problem": "unknown"}
    return out | ({"problem": "declared_type"} if declared and declared != out["type"] else {})


@pandas_udf(T.StructType([T.StructField("type", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("problem", T.StringType())]))
def image_info(content: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """Type and size of PNG, JPEG, GIF and WEBP bytes, or what is wrong with them."""
    return pd.DataFrame([_image(c, d) for c, d in zip(content, declared, strict=True)], columns=["type", "width", "height", "problem"])


def equal_images(images: DataFrame) -> DataFrame:
    """images: locator, content, problem. One row of equal content with its origins; unreadable ones are warnings."""
    good = images.where("problem is null").groupBy(F.sha2("content", 256).alias("sha256")).agg(F.sort_array(F.collect_list("locator")).alias("origins"))
    bad = images.where("problem is not null").select(F.lit(None).cast("string").alias("sha256"), F.array("locator").alias("origins"), F.col("problem").alias("warning"))
    return good.withColumn("warning", F.lit(None).cast("string")).unionByName(bad)


@pandas_udf(T.IntegerType())
def unit_count(path: pd.Series, content: pd.Series) -> pd.Series:
    """Units of a file: the sheets of an .xlsx, 1 for others; null where an .xlsx can't be read. (PDF pages need a library that isn't here.)"""

    def count(name: str | None, data: bytes | None) -> int | None:
        if not (name or "").lower().endswith(".xlsx"):
            return 1
        try:
            return sum(bool(re.fullmatch(r"xl/worksheets/[^/]+\.xml", m)) for m in zipfile.ZipFile(io.BytesIO(data or b"")).namelist())
        except zipfile.BadZipFile:
            return None

    return pd.Series([count(*x) for x in zip(path, content, strict=True)], dtype="Int32")


def finite(x: Column) -> Column:
    """The number, or null where JSON has none for it."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def export_bundle(campaign: DataFrame, entities: DataFrame, path: str) -> None:
    """Text files of one JSON object a line: the campaign and each entity, with the bundle's format and version."""
    head = lambda part: [F.lit("tomeforge-export").alias("format"), F.lit(1).alias("version"), F.lit(part).alias("part")]
    line = lambda df, part: df.select(F.to_json(F.struct(*head(part), F.struct(*df.columns).alias("data"))).alias("value"))
    line(campaign, "campaign").union(line(entities, "entity")).write.text(path)


def publish(pages: DataFrame, ready_sources: DataFrame, path: str) -> None:
    """Pages of complete sources only, as Parquet by source; a rerun replaces the sources that it has."""
    done = pages.join(ready_sources.select("source"), "source", "left_semi")
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
