"""Near-duplicate documents by ProbMinHash, banding and verification.

A document's elements are its distinct runs of SHINGLE words. A word of more than LONG bytes that is
not ASCII for the most part, as text without blanks is, counts as its single characters. An element's
weight is 1, and up to HEAVIEST where it occurs again; a text of fewer words is one element. Each element
is a Poisson process whose rate is its weight: arrivals come at exponential distances, each at a random
register; a register keeps the element of its earliest arrival, and an element stops as soon as its
time exceeds the latest one that any register of its document holds. Registers of two documents agree
with the probability Jaccard similarity of their weighted elements, which is at least the sets' Jaccard
similarity divided by HEAVIEST.

Texts with equal words (by a 128-bit digest of the words) form one class before anything else. Registers
are cut into bands; the class representatives that share a band form a bucket. Every member of a bucket
is compared with the bucket's least one, so that a large group of copies costs one comparison a member.
Where that leaves a bucket in several components, its members are joined by a prefix filter, which
loses no similar pair: elements in order of how few documents have them, two similar sets share one so
early in both that enough others can follow. Most members of a large group that aren't similar to its
least one begin with elements that nothing else has. (Documents of one template that are all just
below THRESHOLD do share such elements, and are compared in pairs.) A comparison counts if the exact
Jaccard similarity of the two sets of elements is THRESHOLD or more. Classes are the connected components.

Null and empty texts and texts without a word are classes of their own; very long texts are taken whole.
Repeated rows share a class; rows of one doc_id with different texts are one class, together with
what is similar to any of them. A row without doc_id is in the class of its copies, or has no class id.
Only named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.components import components
from tomeforge.llm.tables import extended, mapped, table, written
from tomeforge.llm.textbytes import IS_WORD, Slice, Words, hashes, joined_rows, mix, slices, windows, words

U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6 where elements occur
#: equally often in both, and with (1 - (0.8 / 1.15) ** 4) ** 24 = 0.002 at most, whatever they weigh.
BANDS, ROWS, HEAVIEST = 24, 4, 1.15
#: Bytes of a word above which text that isn't ASCII is taken by characters.
LONG = 48


def units(part: Slice) -> Words:
    """Words, long ones without blanks as characters."""
    w = words(part)
    size = w.end - w.start
    if not len(size) or size.max() <= LONG:
        return w
    wide = np.concatenate([[0], np.cumsum(w.data >= 128)])
    long = np.flatnonzero((size > LONG) & (2 * (wide[w.end] - wide[w.start]) > size))
    if not len(long):
        return w
    begins = np.zeros(len(w.data) + 1, dtype=np.int32)
    np.add.at(begins, w.start[long], 1)
    np.add.at(begins, w.end[long], -1)
    mark = (np.cumsum(begins[:-1]) > 0) & ((w.data & 0xC0) != 0x80)
    mark[w.start] = True
    start = np.flatnonzero(mark)
    word = np.searchsorted(w.start, start, side="right") - 1
    end = w.end[word]
    inner = word[1:] == word[:-1]
    end[:-1][inner] = start[1:][inner]
    return Words(w.data, start, end, hashes(w.data, IS_WORD[w.data], start, end), np.searchsorted(start, part.bounds))


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + (HEAVIEST - 1) * np.minimum(1.0, np.log2(count) / 3)


def elements(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each row."""
    row = w.row_of()
    first, h = windows(w, SHINGLE)
    owner = row[first]
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < SHINGLE))
    if len(short):
        value = np.array([_sequence(w.hash[w.rows[r] : w.rows[r + 1]], 1) for r in short], dtype=U)
        owner, h = np.concatenate([owner, short]), np.concatenate([h, value])
    _, at, count = np.unique(mix(h ^ mix(owner.astype(U) + U(1))), return_index=True, return_counts=True)
    return owner[at], h[at], count


def _sequence(hashes: np.ndarray, seed: int) -> np.uint64:
    """A hash of words in order."""
    place = mix(np.arange(1, len(hashes) + 1, dtype=U) + U(seed << 40)) | U(1)
    return mix(np.array([np.add.reduce(mix(hashes * place), dtype=U) + U(len(hashes))], dtype=U))[0]


def registers(rows: int, owner: np.ndarray, h: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """[rows, k] hashes of the elements that hold each register; rows without elements hold 0."""
    times = np.full(rows * k, np.inf)
    held = np.zeros(rows * k, dtype=U)
    at = np.zeros(len(h))
    own, elem, rate = owner, h, weight
    step = 0
    while len(own):
        step += 1
        draw = mix(elem + U(2 * step * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = at - np.log(((draw >> U(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
        place = own * k + (mix(draw + U(1)) % U(k)).astype(np.int64)
        np.minimum.at(times, place, at)
        won = times[place] == at
        held[place[won]] = elem[won]
        live = at < times.reshape(rows, k).max(axis=1)[own]
        own, elem, rate, at = own[live], elem[live], rate[live], at[live]
    return held.reshape(rows, k)


def _keyed(documents: DataFrame) -> DataFrame:
    """Texts with their key: the doc_id and a hash, which tells rows of one doc_id apart."""
    return documents.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("content")).alias("node"), "text")


def signed(documents: DataFrame) -> DataFrame:
    """The key of each row, a digest of its words as two numbers (null without words) and the band keys."""
    rows = _keyed(documents)
    schema = extended(rows, ["node"], "k1 long,k2 long,bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands = ([], []), []
            for part in slices(batch.column("text")):
                for text in joined_rows(words(part)):
                    own = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), np.int64).tolist() if text else (None, None)
                    keys[0].append(own[0])
                    keys[1].append(own[1])
                w = units(part)
                n = len(w.rows) - 1
                owner, h, count = elements(w)
                held = registers(n, owner, h, weights(count), BANDS * ROWS).reshape(n, BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
                for i in range(ROWS):
                    key = mix(key ^ held[:, :, i])
                bands += [x if some else None for x, some in zip(key.view(np.int64), w.counts() > 0, strict=True)]
            columns = [batch.column("node"), *(pa.array(k, pa.int64()) for k in keys), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "k1", "k2", "bands"])

    return mapped(rows, run, schema)


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those whose texts are similar."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            sides = [slices(batch.column(c), 1 << 19) for c in ("text_a", "text_b")]
            held: list = [[], []]  # per side: (row of the batch, its distinct shingles)
            for side, parts in enumerate(sides):
                for part in parts:
                    owner, h, _ = elements(units(part))
                    order = np.argsort(owner, kind="stable")
                    edges = np.searchsorted(owner[order], np.arange(part.last - part.first + 1))
                    held[side] += [h[order[a:b]] for a, b in zip(edges, edges[1:], strict=False)]
            for x, y in zip(*held, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9 if len(x) and len(y) else False)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return mapped(both, run, both.select("a", "b").schema)


def _elements_of(texts: DataFrame) -> DataFrame:
    """node, number of distinct shingles, and the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                n = part.last - part.first
                owner, h, _ = elements(units(part))
                order = np.argsort(owner, kind="stable")
                edges = np.searchsorted(owner[order], np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h[order].view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(part.first, n), pa.array(np.diff(edges), pa.int64()), lists], ["node", "size", "elements"])

    return mapped(texts.select("node", "text"), run, extended(texts, ["node"], "size long, elements array<long>"))


def _prefix_pairs(wanted: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components, one of them `away`, that may be similar; wanted: node, component, away."""
    sets = _elements_of(texts.join(wanted.select("node"), "node", "left_semi"))
    each = written(sets.select("node", "size", F.explode("elements").alias("element")), "elements")
    often = each.groupBy("element").agg(F.count("*").alias("often")).where("often > 1")
    lists = each.join(often, "element").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("list"))
    # elements that no other document has come first, and needn't be listed for that
    placed = lists.select("node", "size", (F.col("size") - F.size("list")).alias("alone"), F.posexplode("list").alias("i", "e"))
    placed = placed.select("node", "size", F.col("e.element").alias("element"), (F.col("alone") + F.col("i")).alias("at")).where(F.col("at") <= (1 - threshold) * F.col("size") + 1e-9)
    placed = placed.join(wanted, "node")
    left = placed.where("away").select("element", *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "at", "component")))
    right = placed.select("element", *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "at", "component")))
    needed = (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    early = (F.col("size_a") - F.col("at_a") >= needed) & (F.col("size_b") - F.col("at_b") >= needed)
    pairs = left.join(right, (left["element"] == right["element"]) & (F.col("component_a") != F.col("component_b")) & early)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _ids(links: DataFrame) -> DataFrame:
    return links.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and copy_of (the least one with equal words)."""
    signs = written(signed(documents), "signatures")
    groups = signs.where("k1 is not null and node.doc_id is not null").groupBy("k1", "k2").agg(F.min("node").alias("rep"), F.first("bands").alias("bands"))
    groups = written(groups, "groups")
    members = groups.select(F.explode("bands").alias("band"), "rep")
    buckets = members.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least != most")
    inside = written(members.join(buckets.select("band", "least"), "band"), "buckets")
    pairs = inside.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = inside.select(F.col("rep").alias("node")).distinct()
    texts = written(_keyed(documents).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    links = _ids(written(_similar(pairs, texts, threshold), "similar"))
    # rows of one doc_id that differ in their words are linked by their classes
    several = signs.where("k1 is not null").groupBy("node.doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x != y").select("doc_id")
    named = signs.select(F.col("node.doc_id").alias("doc_id"), "k1", "k2").join(several, "doc_id").join(groups.select("k1", "k2", "rep"), ["k1", "k2"])
    links = written(links.union(named.where("doc_id != rep.doc_id").select("doc_id", "rep.doc_id").distinct()), "links")
    first = components(links)
    placed = inside.join(first.withColumnRenamed("node", "id"), F.col("rep.doc_id") == F.col("id"), "left").drop("id").withColumn("component", F.coalesce("component", "rep.doc_id"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("band")
    rest = placed.join(mixed, "band")
    home = rest.where("rep = least").select("band", F.col("component").alias("home"))
    rest = rest.join(home, "band").groupBy(F.col("rep").alias("node"), "component").agg(F.max(F.col("component") != F.col("home")).alias("away"))
    more = _prefix_pairs(written(rest, "mixed"), texts, threshold)
    links = links.union(_ids(written(_similar(more, texts, threshold), "similar")))
    named = components(links)
    final = groups.select("k1", "k2", F.col("rep.doc_id").alias("copy_of")).join(named.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    final = final.select("k1", "k2", "copy_of", F.coalesce("component", "copy_of").alias("class_id"))
    known = signs.select(F.col("node.doc_id").alias("doc_id"), "k1", "k2").join(final, ["k1", "k2"], "left")
    return known.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def representatives(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class with all its columns: of its least doc_id the least text; rows without doc_id stay, but for equal texts."""
    gone = classes(documents, threshold).where("class_id != doc_id").select("doc_id").distinct()
    kept = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("own_")
    first = kept.groupBy("doc_id", own).agg(F.min_by(F.struct(*documents.columns), F.struct(F.col("text").isNull(), F.col("text"))).alias("row_"))
    return first.select("row_.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
