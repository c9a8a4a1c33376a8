"""Benchmark decontamination by a broadcast hash set of n-grams.

Every window of `n` consecutive benchmark words (an item of fewer words is one window) is hashed;
the sorted hashes go to the executors in blocks of at most `block_windows` windows, each of which
is scanned against all document windows. A hash hit counts after its words have been compared.
A benchmark that may have more than `most_windows` windows isn't broadcast: its windows are made in
tasks and joined with those of the documents that a bit table of fixed size lets through. Both ways
give the same rows.

Null or empty texts have no words, no hits and no items; very long texts are scanned whole. Repeated item rows count once, an item
without id hits words but is not listed, repeated document rows give one result each. Documents and
benchmark may have more columns; only the named ones are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.tables import extended, free_name, mapped, table, written
from tomeforge.llm.textbytes import Slice, Words, slices, windows, words

N = 10
BLOCK_WINDOWS = 1_000_000
#: Windows that are broadcast at most; each takes about 24 bytes and its item's share of text.
MOST_WINDOWS = 4_000_000
#: Lengths of the bit tables that most windows fail at, of a block and of the join, as powers of two.
FILTER_BITS, JOIN_BITS = 20, 26
#: Candidate windows of a batch on their way to the join.
JOIN_ROWS = 50_000


class Block:
    """Windows of some benchmark items, by length in words: hashes in order, and where each stands."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids = [i for i, _ in items]
        found: dict[int, list] = {}
        self.words = []
        for part in slices(pa.array([t for _, t in items], pa.string())):
            w = words(part)
            for size, first, h in own_windows(w, n):
                row = np.searchsorted(w.rows, first, side="right") - 1 + part.first
                found.setdefault(size, []).append((h, np.full(len(h), len(self.words), np.int32), first.astype(np.int32), row.astype(np.int32)))
            self.words.append(Words(w.data, w.start.astype(np.int32), w.end.astype(np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        self.by_size = {}
        for size, made in found.items():
            keys, *places = (np.concatenate(x) for x in zip(*made, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.by_size[size] = (keys, bits, *(x[order] for x in places))

    def hits(self, w: Words) -> Iterator[tuple[int, int, set]]:
        """First word, number of words and items of each verified window."""
        for size, (keys, bits, part, place, row) in self.by_size.items():
            first, h = windows(w, size)
            maybe = np.flatnonzero(bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = (np.searchsorted(keys, h[maybe], side=side) for side in ("left", "right"))
            hit = low < high
            for i, a, b in zip(maybe[hit], low[hit], high[hit], strict=True):
                gram = w.joined(int(first[i]), size)
                if items := {self.ids[row[j]] for j in range(a, b) if self.words[part[j]].joined(int(place[j]), size) == gram}:
                    yield int(first[i]), size, items


def own_windows(w: Words, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, first words and hashes of each row's windows: of n words, or of all if there are fewer."""
    counts = w.counts()
    for size in np.unique(np.minimum(counts, n)):
        if size:
            first, h = windows(w, int(size))
            counted = counts[np.searchsorted(w.rows, first, side="right") - 1]
            mine = np.minimum(counted, n) == size
            yield int(size), first[mine], h[mine]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()


def blocks(items: DataFrame, most: int, n: int = N, block_windows: int = BLOCK_WINDOWS) -> list:
    """Broadcasts of at most `most` windows, one block of items at a time; one item is never split."""
    parts = most // block_windows + 1
    made = []
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        made.append(items.sparkSession.sparkContext.broadcast(Block([tuple(r) for r in own.toLocalIterator()], n)))
    return made


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    n: int = N,
    clean: bool = False,
    block_windows: int = BLOCK_WINDOWS,
    names: dict[str, str] | None = None,
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """Each document row's `keep` columns, word and hit counts and items.

    With `clean`, also `clean_text`: the text without its hit words and what stands between them.
    names: other names for the new columns.
    """
    items = _items(benchmark)
    # a window begins at a word, which has two characters with its gap
    most = (items.select(F.sum(F.floor((F.length("text") + 1) / 2))).first()[0]) or 0
    if most <= most_windows:
        sent = blocks(items, most, n, block_windows)

        def hits(w: Words, batch: pa.RecordBatch, part: Slice) -> Iterator[tuple[int, int, set]]:
            for block in sent:
                yield from block.value.hits(w)

        return _counted(documents, keep, [], hits, clean, names or {})

    spans, listed = free_name(documents, "spans"), free_name(documents, "listed")

    def told(w: Words, batch: pa.RecordBatch, part: Slice) -> Iterator[tuple[int, int, set]]:
        own = (batch.column(c).slice(part.first, part.last - part.first).to_pylist() for c in (spans, listed))
        for row, (found, ids) in enumerate(zip(*own, strict=True)):
            for span in found or ():
                yield int(w.rows[row]) + span["first"], span["size"], set(ids)

    rows = _with_hits(documents, items, keep, n, spans, listed)
    return _counted(rows, keep, [spans, listed], told, clean, names or {})


def _with_hits(documents: DataFrame, items: DataFrame, keep: list[str], n: int, spans: str, listed: str) -> DataFrame:
    """Documents with their verified windows (first word and length) and these windows' items, by joins."""
    spark, key = documents.sparkSession, free_name(documents, "row_key")
    rows = written(documents.select(*dict.fromkeys([*keep, "text"])).withColumn(key, F.monotonically_increasing_id()), "benchmark-rows")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                w = words(part)
                for size, first, h in own_windows(w, n):
                    ids = batch.column("item_id").take(pa.array(np.searchsorted(w.rows, first, side="right") - 1 + part.first))
                    told = pa.array([w.joined(int(i), size) for i in first], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(h), size), pa.int32()), pa.array(h.view(np.int64)), told], ["item_id", "size", "hash", "gram"])

    made = written(mapped(items, grams, "item_id string, size int, hash long, gram string").distinct(), "benchmark-grams")
    sizes = sorted(r["size"] for r in made.select("size").distinct().collect())
    place = made.select(F.shiftrightunsigned("hash", 64 - JOIN_BITS).alias("place"))
    filled = place.groupBy(F.expr("place div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toPandas()
    bits = np.zeros(1 << JOIN_BITS - 6, dtype=np.uint64)
    bits[filled["at"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                w = words(part)
                for size in sizes:
                    first, h = windows(w, size)
                    at = h >> np.uint64(64 - JOIN_BITS)
                    first = first[(sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    for some in np.split(first, range(JOIN_ROWS, len(first), JOIN_ROWS)):
                        row = np.searchsorted(w.rows, some, side="right") - 1
                        told = pa.array([w.joined(int(i), size) for i in some], pa.binary()).cast(pa.string())
                        columns = [batch.column(key).take(pa.array(row + part.first)), pa.array((some - w.rows[row]).astype(np.int32)), pa.array(np.full(len(some), size), pa.int32()), told]
                        yield pa.RecordBatch.from_arrays(columns, [key, "first", "size", "gram"])

    seen = written(mapped(rows.select(key, "text"), candidates, f"{key} long, first int, size int, gram string"), "benchmark-candidates")
    hit = seen.join(made.select("gram").distinct(), "gram", "left_semi").groupBy(key).agg(F.collect_list(F.struct("first", "size")).alias(spans))
    owners = seen.select(key, "gram").distinct().join(made.select("gram", "item_id"), "gram").groupBy(key).agg(F.collect_set("item_id").alias(listed))
    return rows.join(hit, key, "left").join(owners, key, "left")


def _counted(documents: DataFrame, keep: list[str], more: list[str], hits: Callable, clean: bool, names: dict[str, str]) -> DataFrame:
    """Words, hit words, items and clean texts of documents.

    hits: first word, length and items of a slice's windows, of its words, its batch (with the columns `more`) and itself.
    """
    kinds = {"n_words": "long", "n_hit": "long", "items": "array<string>"} | ({"clean_text": "string"} if clean else {})
    added = {names.get(c, c): kind for c, kind in kinds.items()}
    schema = extended(documents, keep, ",".join(f"{c} {kind}" for c, kind in added.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hit_counts, found, texts = [], [], [], []
            for part in slices(batch.column("text")):
                w = words(part)
                hit = np.zeros(len(w.hash) + 1, dtype=np.int32)
                items: dict[int, set] = {}
                for first, size, own in hits(w, batch, part):
                    hit[first] += 1
                    hit[first + size] -= 1
                    items.setdefault(int(np.searchsorted(w.rows, first, side="right")) - 1, set()).update(own)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
                counts.append(w.counts())
                hit_counts.append(np.diff(covered[w.rows]))
                found += [sorted(x for x in items.get(r, ()) if x is not None) for r in range(part.last - part.first)]
                if clean:
                    texts += [_without(part, w, covered, r) if r in items else part.text(r) for r in range(part.last - part.first)]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (counts, hit_counts)]
            columns.append(pa.array(found, pa.list_(pa.string())))
            if clean:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    return mapped(documents.select(*dict.fromkeys([*keep, "text", *more])), run, schema)


def _without(part, w: Words, covered: np.ndarray, row: int) -> str:
    """The row's text without runs of hit words; a run takes along what stands between its words."""
    first, last = int(w.rows[row]), int(w.rows[row + 1])
    hit = np.diff(covered[first : last + 1]) > 0
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    pieces, at = [], int(part.bounds[row])
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        pieces.append(part.data[at : w.start[first + a]].tobytes())
        at = int(w.end[first + b - 1])
    pieces.append(part.data[at : part.bounds[row + 1]].tobytes())
    return b"".join(pieces).decode("utf-8", "replace")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words as lists; windows of each benchmark length; a word is hit if a window that holds it occurs.
OP8_SQL = r"""
with d as (select doc_id, row_number() over () as rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
s as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
g as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as gram from (select *, unnest(range(1, len(w) - n + 2)) as i from s)),
sizes as (select distinct n from g),
v as (select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as gram from (select d.*, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
h as (select v.rid, v.n, v.i, g.item_id from v join g on v.n = g.n and v.gram = g.gram),
p as (select rid, count(distinct j) as n_hit from (select rid, unnest(range(i, i + n)) as j from h) group by rid),
t as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from h group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(p.n_hit, 0) as bigint) as n_hit,
    cast(coalesce(t.n_items, 0) as bigint) as n_items, sha256(coalesce(t.items, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from d left join p using (rid) left join t using (rid)
"""
