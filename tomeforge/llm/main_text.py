"""Main text of HTML pages by differencing with the page of the nearest URL.

A page's lines are its <article>'s, without one its <main>'s, without either all; what stands in
navigation, headers, footers, forms, adverts, comments and the like, by element or by a name that says so, goes (see
html_lines.py, also for what such marks can't do: empty a page). Every page with a host is differenced. Pages
of a host are put in order of their paths; each is paired with the neighbour whose path has the longer
common beginning (the one before, of two equal ones), its lines are aligned with all lines of that
page by a longest common subsequence, and the aligned ones are deleted, place by place. Neighbours
that have the same main lines are passed over, to the next that differs, so that copies of a page don't
delete each other; copies get one text.

A check follows: of the deleted lines those that the page itself shows to be the article's own come back, namely text in
an <article> that isn't mostly links and that no hint (a name like `share-price`) is around. Such a line is what two
articles say, a passage or a phrase, not a part of the site. n_shared counts the lines deleted before the check.

The pages are read twice: first for hashes of their lines, which are sorted and paired, then for their texts, to which the
places found are joined. The hashes are sorted by (host, path, lines, page_id) in range partitions of about PART_BYTES, so
that a large host is many partitions. What
stands at the border between two partitions, where a run of copies may go on over any number of them,
is paired afterwards: the driver sees two short rows of each partition, which name the rows that belong
together; these are joined as tables.

A null or empty page, or one without text, gives an empty text; a page without a host is paired with
none; very long pages are parsed and aligned whole. Repeated rows have the same neighbours and text.
Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.html_lines import ARTICLE, MAIN, OUTSIDE, lines, shared
from tomeforge.llm.tables import BATCH_ROWS, extended, mapped, table, written
from tomeforge.llm.textbytes import Slice, mix, words

PART_BYTES = 64 << 20
#: A hash that no line has.
NONE = 0
_ANY = np.ones(256, dtype=bool)
#: Rows at a partition's border: the first and last one, the ones next to their runs of copies, and the runs' own lines.
FIRST, SECOND, LAST, BEFORE_LAST, OWN_FIRST, OWN_LAST = 1, 2, 3, 4, 5, 6


def _keys(found: list[str]) -> list[int]:
    """A 64-bit hash of each line."""
    if not found:
        return []
    data = [x.encode("utf-8", "replace") for x in found]
    bounds = np.cumsum([0, *map(len, data)])
    part = Slice(0, len(data), np.frombuffer(b"".join(data), np.uint8), bounds)
    made = mix(words(part, _ANY, lower=False).hash).view(np.int64)
    return np.where(made == NONE, 1, made).tolist()


def _addressed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and path."""
    url = F.lower(F.coalesce("url", F.lit("")))
    return pages.select(
        "page_id",
        "url",
        "html",
        F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1).alias("host"),
        F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1).alias("path"),
    )


def _own(page: str | None) -> tuple[list[tuple[str, int, bool]], list[int], list[int], str]:
    """A page's lines, the places of its own ones, hashes of all lines, and a digest of the own ones."""
    found = lines(page or "")
    kinds = {k for _, k, _ in found}
    kind = ARTICLE if ARTICLE in kinds else MAIN if MAIN in kinds else OUTSIDE
    places = [i for i, (_, k, _) in enumerate(found) if k == kind]
    keys = _keys([x for x, _, _ in found])
    same = hashlib.blake2b(np.array([keys[i] for i in places], dtype=np.int64).tobytes(), digest_size=16).hexdigest()
    return found, places, keys, same


def listed(pages: DataFrame) -> DataFrame:
    """page_id, host, path, keys: hashes of all lines, places: of the page's own lines, and same: a digest of those; of each page with a host."""
    rows = _addressed(pages).where("host != ''").drop("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_own(page)[1:] for page in batch.column("html").to_pylist()]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string())
            kept = [batch.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], ["page_id", "host", "path", "places", "keys", "same"])

    return mapped(rows, run, extended(rows, ["page_id", "host", "path"], "places array<int>,keys array<long>,same string"))


def _told(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, same, and either the text, of pages whose lines all pass the check, or the own lines and whether each fails it if a neighbour has it."""
    rows = _addressed(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: tuple[list, ...] = ([], [], [], [])
            for page in batch.column("html").to_pylist():
                found, places, _, same = _own(page)
                own = [found[i][0] for i in places]
                loose = [found[i][1] != ARTICLE or found[i][2] for i in places]
                row = (same, None, own, loose) if any(loose) else (same, " ".join(own), None, None)
                for c, x in zip(made, row, strict=True):
                    c.append(x)
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()))
            kept = [batch.column(c) for c in ("page_id", "url", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], ["page_id", "url", "host", "path", "same", "text", "own", "loose"])

    return mapped(rows, run, extended(rows, ["page_id", "url", "host", "path"], "same string,text string,own array<string>,loose array<boolean>"))


def _gone(own_keys: list[int], near: list[int] | None) -> list[int]:
    """Places, among a page's own lines, of those that are aligned with the neighbour's lines, by their hashes."""
    return sorted(shared(own_keys, near)) if near is not None else []


def _nearer(path: str, before: dict | None, after: dict | None) -> dict | None:
    """The neighbour whose path has the longer common beginning with this one."""
    if before is None or after is None:
        return before or after
    common = lambda other: len(os.path.commonprefix([other["path"], path]))
    return before if common(before) >= common(after) else after


class _Run:
    """Neighbouring rows of a host with the same lines."""

    def __init__(self, row: dict):
        self.host, self.same, self.first, self.last = row["host"], row["same"], row, row
        self.own_keys = [row["keys"][i] for i in row["places"]]
        self.paths: list[str] = []

    def takes(self, row: dict) -> bool:
        return row["host"] == self.host and row["same"] == self.same

    def add(self, row: dict) -> None:
        self.last = row
        if not self.paths or self.paths[-1] != row["path"]:
            self.paths.append(row["path"])

    def near(self, row: dict | None) -> dict | None:
        return row if row is not None and row["host"] == self.host else None


def _paired(ordered: DataFrame) -> DataFrame:
    """For the sorted rows: places that go, by host, path and same (edge 0), rows of runs at a border (edge 1 first run, 2 last, 3 the only one) and the border rows (slot > 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        kinds = [("host", pa.string()), ("path", pa.string()), ("same", pa.string()), ("gone", pa.list_(pa.int32())), ("part", pa.int32()), ("edge", pa.int32()), ("slot", pa.int32()), ("keys", pa.list_(pa.int64()))]
        schema = pa.schema(kinds)

        def given(full: bool) -> Iterator[pa.RecordBatch]:
            if out and (full or len(out) >= BATCH_ROWS):
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()

        def border(slot: int, row: dict, keys: list[int]) -> dict:
            return {"part": part, "slot": slot, "keys": keys} | {c: row[c] for c in ("host", "path", "same")}

        def ended(current: _Run, before: _Run | None, after: dict | None, edge: int) -> Iterator[pa.RecordBatch]:
            """Rows of a run that ends; `after` is the first row of the next one."""
            if edge:
                if edge & 1:
                    out.append(border(FIRST, current.first, current.first["keys"]))
                    if after is not None:
                        out.append(border(SECOND, after, after["keys"]))
                if edge & 2:
                    out.append(border(LAST, current.last, current.last["keys"]))
                    if before is not None:
                        out.append(border(BEFORE_LAST, before.last, before.last["keys"]))
                out.append(border(OWN_FIRST if edge & 1 else OWN_LAST, current.first, current.own_keys))
            made: dict = {}
            for path in current.paths:
                gone = None
                if not edge:
                    near = _nearer(path, current.near(before and before.last), current.near(after))
                    if id(near) not in made:
                        made[id(near)] = _gone(current.own_keys, near["keys"] if near else None)
                    gone = made[id(near)]
                if edge or gone:
                    out.append({"host": current.host, "path": path, "same": current.same, "gone": gone, "part": part, "edge": edge, "slot": 0})
                yield from given(False)

        before = current = None
        for batch in batches:
            for row in batch.to_pylist():
                if current is not None and not current.takes(row):
                    yield from ended(current, before, row, 0 if before else 1)
                    before, current = current, None
                    before.paths.clear()
                current = current or _Run(row)
                current.add(row)
        if current is not None:
            yield from ended(current, before, None, 2 if before else 3)
            yield from given(True)

    return mapped(ordered, run, "host string,path string,same string,gone array<int>,part int,edge int,slot int,keys array<long>")


def _borders(ends: list) -> list[tuple[int, int, int, int, int]]:
    """(partition, edge, side: 0 before and 1 after, partition and slot of the row next to that run), from first and last rows by partition."""
    parts = sorted({r.part for r in ends})
    at = {(r.part, r.slot): (r.host, r.same) for r in ends}
    alone = {p: (p, SECOND) not in at for p in parts}
    found = []

    def beyond(i: int, side: int, own: tuple) -> tuple[int, int] | None:
        """The row next to the run on that side, whose lines differ; the run may go on over partitions."""
        step, end, inside = (1, FIRST, SECOND) if side else (-1, LAST, BEFORE_LAST)
        i += step
        while 0 <= i < len(parts):
            p = parts[i]
            if at[p, end] != own:
                return (p, end) if at[p, end][0] == own[0] else None
            if not alone[p]:
                return (p, inside) if at[p, inside][0] == own[0] else None
            i += step
        return None

    for i, p in enumerate(parts):
        for edge in [3] if alone[p] else [1, 2]:
            own = at[p, LAST if edge == 2 else FIRST]
            for side in (0, 1):
                if edge == 3 or edge == side + 1:
                    row = beyond(i, side, own)
                else:
                    row = (p, BEFORE_LAST if edge == 2 else SECOND)
                    row = row if at[row][0] == own[0] else None
                if row:
                    found.append((p, edge, side, *row))
    return found


def _at_borders(paired: DataFrame) -> DataFrame:
    """Places that go from the rows of runs at a border."""
    spark = paired.sparkSession
    slots = paired.where("slot > 0")
    ends = slots.where(F.col("slot") <= BEFORE_LAST).select("part", "slot", "host", "same").collect()  # four short rows a partition
    refs = spark.createDataFrame(_borders(ends), "part int,edge int,side int,at int,slot int")
    rows = slots.select(F.col("part").alias("at"), "slot", "path", "keys")
    near = refs.join(rows, ["at", "slot"]).groupBy("part", "edge").agg(*(F.max(F.when(F.col("side") == side, F.struct("path", "keys"))).alias(name) for side, name in ((0, "before"), (1, "after"))))
    own = slots.where(F.col("slot") >= OWN_FIRST).select("part", F.col("slot").alias("own_slot"), F.col("keys").alias("own_keys"))
    waiting = paired.where("slot = 0 and edge > 0").select("host", "path", "same", "part", "edge")
    waiting = waiting.withColumn("own_slot", F.when(F.col("edge") == 2, OWN_LAST).otherwise(OWN_FIRST))
    joined = waiting.join(own, ["part", "own_slot"]).join(near, ["part", "edge"]).select("host", "path", "same", "own_keys", "before", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        for batch in batches:
            gone = []
            for row in batch.to_pylist():
                asked = row["own_keys"], _nearer(row["path"], row["before"], row["after"])["keys"]
                if not last or last[0] != asked:
                    last = asked, _gone(*asked)
                gone.append(last[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "path", "same")), pa.array(gone, pa.list_(pa.int32()))], ["host", "path", "same", "gone"])

    return mapped(joined, run, "host string,path string,same string,gone array<int>")


def differenced(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame | None:
    """host, path and same of pages that share own lines with the nearest page, and the places of those lines; None if no page has a host."""
    spark = pages.sparkSession
    rows = written(listed(pages), "lines")
    size = rows.select(F.sum(8 * F.size("keys") + 4 * F.size("places") + 200)).first()[0]
    if size is None:
        return None
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    order = ["host", "path", "same", "page_id"]
    paired = written(_paired(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)), "paired")
    found = paired.where("slot = 0 and edge = 0").select("host", "path", "same", "gone").union(_at_borders(paired).where(F.size("gone") > 0))
    return written(found.groupBy("host", "path", "same").agg(F.max("gone").alias("gone")), "gone")  # copies at two partitions' border come twice


def extracted(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """page_id, url and main text of each row, and n_shared: how many of its own lines the nearest page has too."""
    found = differenced(pages, part_bytes)
    rows = _told(pages)
    rows = rows.withColumn("gone", F.lit(None).cast("array<int>")) if found is None else rows.join(found, ["host", "path", "same"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    stays = F.filter("own", lambda _, i: ~(F.array_contains(gone, i) & F.element_at("loose", i + 1)))
    return rows.select("page_id", "url", F.coalesce("text", F.concat_ws(" ", stays)).alias("text"), F.size(gone).cast("long").alias("n_shared"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
