"""Workbooks (.xlsx) by format name: a row for each row of each sheet, read as a stream of zipped XML; and a sink.

    spark.read.format("tomeforge_workbooks").load(folder)

A cell is its text: shared and inline strings as they are, numbers as they are written, booleans TRUE and FALSE, and a
formula, which is never evaluated, with an equals sign before it; cells that aren't there are null. No sheet is
held whole, only the workbook's shared strings, which like each sheet are limited in size. units() joins a
sheet's rows to a text, which is the workbook's unit.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tomeforge.functions.text import escape_html
from tomeforge.sources.archives import MEMBER_BYTES, PARTITION_BYTES, Run, opened, register, runs

ROWS = "file string, sheet int, name string, row int, cells array<string>, problem string"
_SCHEMA = pa.schema([("file", pa.string()), ("sheet", pa.int32()), ("name", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("problem", pa.string())])
#: Columns that a sheet can have (a fixed value), and rows of a batch.
MOST_COLUMNS, BATCH_ROWS = 16_384, 2000
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Damaged(ValueError):
    """A part of a workbook that can't be read."""


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _events(archive: zipfile.ZipFile, name: str, limit: int) -> Iterator[tuple[str, ElementTree.Element]]:
    """Starts and ends of the elements of a member; without document types, which XML of workbooks never has."""
    try:
        info = archive.getinfo(name)
    except KeyError as e:
        raise Damaged(f"missing {name}") from e
    if info.file_size > limit:
        raise Damaged("too_large")
    parser = ElementTree.XMLPullParser(["start", "end"])
    try:
        with archive.open(info) as data:
            tail = b""
            while chunk := data.read(1 << 16):
                if b"<!DOCTYPE" in tail + chunk:
                    raise Damaged("unsafe_xml")
                tail = chunk[-16:]
                parser.feed(chunk)
                yield from ((kind, element) for kind, element in parser.read_events())
        parser.close()
        yield from parser.read_events()
    except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError) as e:
        raise Damaged("unreadable") from e


def _text(element: ElementTree.Element) -> str:
    """The text of a string with its runs, without phonetic ones."""
    parts = []
    for child in element:
        if _plain(child.tag) == "t":
            parts.append(child.text or "")
        elif _plain(child.tag) == "r":
            parts += [t.text or "" for t in child if _plain(t.tag) == "t"]
    return "".join(parts)


def strings(archive: zipfile.ZipFile, name: str, limit: int) -> list[str]:
    found = []
    for kind, element in _events(archive, name, limit):
        if kind == "end" and _plain(element.tag) == "si":
            found.append(_text(element))
            element.clear()
    return found


def _sheets(archive: zipfile.ZipFile, limit: int) -> tuple[list[tuple[str, str]], list[str]]:
    """(name, member) of the sheets in order, and the shared strings."""
    targets, shared = {}, []
    for kind, e in _events(archive, "xl/_rels/workbook.xml.rels", limit):
        if kind == "end" and _plain(e.tag) == "Relationship":
            target = e.get("Target", "")
            targets[e.get("Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
            if e.get("Type", "").endswith("/sharedStrings"):
                shared = strings(archive, targets[e.get("Id")], limit)
    listed = [(e.get("name", ""), e.get(RELATION)) for kind, e in _events(archive, "xl/workbook.xml", limit) if kind == "end" and _plain(e.tag) == "sheet"]
    return [(name, targets.get(to, "")) for name, to in listed], shared


def column(reference: str) -> int:
    """The column of a reference like AB12, from 0."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(element: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value, formula, inline = element.get("t", "n"), None, None, None
    for child in element:
        tag = _plain(child.tag)
        if tag == "v":
            value = child.text or ""
        elif tag == "f":
            formula = child.text
        elif tag == "is":
            inline = _text(child)
    if formula is not None:
        return f"={formula}"
    if kind == "inlineStr":
        return inline
    if kind == "s" and value is not None:
        if not value.isdigit() or int(value) >= len(shared):
            raise Damaged("unknown_string")
        return shared[int(value)]
    if kind == "b" and value is not None:
        return "TRUE" if value == "1" else "FALSE"
    return value


def rows_of_sheet(archive: zipfile.ZipFile, name: str, shared: list[str], limit: int) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells) of the rows that have a cell."""
    row, cells = 0, []
    for kind, element in _events(archive, name, limit):
        tag = _plain(element.tag)
        if kind == "start" and tag == "row":
            row, cells = int(element.get("r", row + 1)), []
        elif kind == "end" and tag == "c":
            at = column(element.get("r", "")) if element.get("r") else len(cells)
            if not 0 <= at < MOST_COLUMNS:
                raise Damaged("bad_reference")
            cells += [None] * (at + 1 - len(cells))
            cells[at] = _cell(element, shared)
            element.clear()
        elif kind == "end" and tag == "row":
            if any(c is not None for c in cells):
                yield row, cells
            element.clear()
        elif kind == "end" and tag == "sheetData":
            element.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.limit = path, int(options.get("memberBytes", MEMBER_BYTES))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        return runs(self.path, (".xlsx",), self.partition_bytes, split=False) or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        store, held = opened(self.path)[0], []
        for name, _, _ in partition.files:
            for row in self._workbook(store, name):
                held.append(dict(zip(_SCHEMA.names, (name.rsplit("/", 1)[-1], *row), strict=True)))
                if len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    def _workbook(self, store, name: str) -> Iterator[tuple]:
        try:
            with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                sheets, shared = _sheets(archive, self.limit)
                for n, (title, member) in enumerate(sheets, 1):
                    try:
                        for row, cells in rows_of_sheet(archive, member, shared, self.limit):
                            yield n, title, row, cells, None
                    except (Damaged, ValueError) as e:
                        yield n, title, None, None, str(e) if isinstance(e, Damaged) else "unreadable"
        except Damaged as e:
            yield None, None, None, None, str(e)
        except (zipfile.BadZipFile, EOFError, pa.ArrowInvalid):
            yield None, None, None, None, "unreadable"


class Workbooks(DataSource):
    """Rows of workbooks' sheets (from 1). `problem`, in a row of its own after the rows that could be read: unreadable, too_large, missing ..., unsafe_xml, unknown_string or bad_reference; without a sheet it is the workbook's."""

    @classmethod
    def name(cls) -> str:
        return "tomeforge_workbooks"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        if schema.names != _SCHEMA.names:
            raise ValueError(f"the columns are {ROWS}")
        return WorkbookReader(self.options["path"], self.options)


def workbooks(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Workbooks)
    return spark.read.format("tomeforge_workbooks").options(**options).load(path)


def units(rows: DataFrame) -> DataFrame:
    """(file, unit, name, text, n_rows) of each sheet: its rows as lines of a Markdown table. A sheet without rows has none; its file's limit bounds a sheet."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", cell), " | "), F.lit(" |"))
    held = rows.where("problem is null").groupBy("file", F.col("sheet").alias("unit"), "name").agg(F.sort_array(F.collect_list(F.struct("row", line.alias("line")))).alias("lines"))
    return held.select("file", "unit", "name", F.array_join("lines.line", "\n").alias("text"), F.size("lines").alias("n_rows"))


def _letters(n: Column) -> Column:
    """The letters of a column from 0, of 702 columns."""
    letter = lambda k: F.chr(F.lit(65) + k)
    return F.when(n < 26, letter(n)).otherwise(F.concat(letter(F.floor(n / 26) - 1), letter(n % 26)))


def members_of_workbooks(rows: DataFrame) -> DataFrame:
    """rows: (workbook, sheet, name, row, cells). (archive, member, content) of the workbooks' parts, for the archive sink.

    Cells that begin with an equals sign are formulas, numbers are numbers, all else are shared strings.
    """
    cells = rows.select("workbook", "sheet", "row", F.posexplode("cells").alias("at", "value")).where("value is not null")
    kind = F.when(F.col("value").startswith("="), "f").when(F.col("value").rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"), "n").otherwise("s")
    cells = cells.withColumn("kind", kind)
    texts = cells.where("kind = 's'").select("workbook", "value").distinct()
    texts = texts.withColumn("number", F.row_number().over(Window.partitionBy("workbook").orderBy("value")) - 1)
    cells = cells.join(texts.withColumn("kind", F.lit("s")), ["workbook", "value", "kind"], "left")
    place = F.concat(_letters(F.col("at")), F.col("row").cast("string"))
    start = F.concat(F.lit('<c r="'), place, F.lit('"'))
    xml = (
        F.when(F.col("kind") == "f", F.concat(start, F.lit("><f>"), escape_html(F.substring("value", 2, 1 << 30)), F.lit("</f></c>")))
        .when(F.col("kind") == "n", F.concat(start, F.lit("><v>"), "value", F.lit("</v></c>")))
        .otherwise(F.concat(start, F.lit(' t="s"><v>'), F.col("number").cast("string"), F.lit("</v></c>")))
    )
    joined = lambda order, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("x")))), lambda s: s["x"]), "")
    line = cells.groupBy("workbook", "sheet", "row").agg(joined("at", xml).alias("xml"))
    line = line.withColumn("xml", F.concat(F.lit('<row r="'), F.col("row").cast("string"), F.lit('">'), "xml", F.lit("</row>")))
    head, main = '<?xml version="1.0" encoding="UTF-8"?>', ' xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = line.groupBy("workbook", "sheet").agg(joined("row", F.col("xml")).alias("xml"))
    sheet_name = F.concat(F.lit("sheet"), F.col("sheet").cast("string"), F.lit(".xml"))
    sheets = data.select("workbook", F.concat(F.lit("xl/worksheets/"), sheet_name).alias("member"), F.concat(F.lit(f"{head}<worksheet{main}><sheetData>"), "xml", F.lit("</sheetData></worksheet>")).alias("xml"))
    listed = rows.select("workbook", "sheet", "name").distinct()
    number = F.col("sheet").cast("string")
    entry = F.concat(F.lit('<sheet name="'), escape_html(F.col("name")), F.lit('" sheetId="'), number, F.lit('" r:id="r'), number, F.lit('"/>'))
    relation = F.concat(F.lit('<Relationship Id="r'), number, F.lit(f'" Type="{office}/worksheet" Target="worksheets/'), sheet_name, F.lit('"/>'))
    books = listed.groupBy("workbook").agg(joined("sheet", entry).alias("entries"), joined("sheet", relation).alias("relations"))
    book = books.select("workbook", F.lit("xl/workbook.xml").alias("member"), F.concat(F.lit(f'{head}<workbook{main} xmlns:r="{office}"><sheets>'), "entries", F.lit("</sheets></workbook>")).alias("xml"))
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    rels = books.select(
        "workbook",
        F.lit("xl/_rels/workbook.xml.rels").alias("member"),
        F.concat(F.lit(f'{head}<Relationships xmlns="{package}">'), "relations", F.lit(f'<Relationship Id="s" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')).alias("xml"),
    )
    string = F.concat(F.lit('<si><t xml:space="preserve">'), escape_html(F.col("value")), F.lit("</t></si>"))
    all_texts = listed.select("workbook").distinct().join(texts.groupBy("workbook").agg(joined("number", string).alias("xml")), "workbook", "left")
    shared = all_texts.select("workbook", F.lit("xl/sharedStrings.xml").alias("member"), F.concat(F.lit(f"{head}<sst{main}>"), F.coalesce("xml", F.lit("")), F.lit("</sst>")).alias("xml"))
    parts = sheets.union(book).union(rels).union(shared)
    return parts.select(F.col("workbook").alias("archive"), "member", F.encode("xml", "UTF-8").alias("content"))


def write_workbooks(members: DataFrame, path: str) -> None:
    """The parts of members_of_workbooks() as .xlsx files."""
    register(members.sparkSession)
    members.repartition("archive").sortWithinPartitions("archive", "member").write.format("tomeforge_archives").option("suffix", ".xlsx").mode("append").save(path)
