"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A document's lines, trimmed, are compared over all documents: for equality all that aren't empty
(`least` is ALL_LINES, as in op9) or those of MIN_CHARS characters or more, for edits the latter. Equal
lines are one class. Distinct lines within an edit distance of one are linked: a line is cut into two
segments (threshold plus one), of which an edit leaves one as it is; segments are indexed by length
and number, and each line probes the index of its own length and of the next shorter one with its
beginning and its end. Two lines in a bucket are a candidate pair, which a banded bit-parallel edit
distance verifies. A bucket of more than SMALL lines, repeats included, isn't paired up: there the rest of each line, and
the rest without each one of its characters, is a finer key (made by blocks, so that long lines take time
in proportion to their length, but for hashes of what stands outside of each block); lines that share one differ in that
character at most, and one link each to the key's least line holds them together without loss.

Classes are connected components. The first line of a class (least doc_id, then position) stays in its
document, all others go. Null texts stay null; empty texts and lines that are not compared are left alone;
very long texts are taken whole, in time n log n of their lines. Documents without doc_id keep all their
lines. Rows of one doc_id with different texts are compared with each other as any; rows that repeat
doc_id and text are one document, and alike afterwards. An empty table gives an empty result. Columns besides
doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.components import components
from tomeforge.llm.tables import free_name, table, written

MIN_CHARS, SMALL, BLOCK = 30, 32, 64
#: Least characters of a line where every line that isn't empty is compared for equality.
ALL_LINES = 1
#: Buckets or candidate lines that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Places of a line in its text, and marks that tell texts of one doc_id apart, in a position number.
_LINES, _MARKS = 1 << 31, 1 << 24


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: Spark would copy the expression to each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def banded_distance(long: Column, short: Column, threshold: int) -> Column:
    """Edit distance of two character arrays, long at least as long as short; threshold + 1 if larger.

    Bit-parallel over the band of 2 * threshold + 1 diagonals (Hyyrö, 2003), whose differences to the
    row below are held as bits; the band slides down by one row with each character.
    """
    return _let(F.struct(long.alias("long"), short.alias("short")), lambda x: _banded(x["long"], x["short"], threshold))


def _banded(long: Column, short: Column, threshold: int) -> Column:
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    start = F.struct(
        F.lit(mask << (width - threshold - 1) & mask).alias("up"), F.lit(0).alias("down"), F.lit(threshold).alias("distance"), F.lit(top >> 1).alias("place")
    )

    def step(state: Column, i: Column) -> Column:
        own = F.get(short, i)
        hit = sum(
            (F.when(F.get(long, i + (threshold - (width - 1 - b))) == own, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(width) if threshold >= width - 1 - b),
            F.lit(0),
        )
        for b in range(width):
            if threshold < width - 1 - b:  # a row above the first has no character
                back = width - 1 - b - threshold
                hit = hit + F.when((i >= back) & (F.get(long, i - back) == own), F.lit(1 << b)).otherwise(F.lit(0))
        return _let(hit, lambda h: _let(_same(h, state["up"], state["down"], mask), lambda same: after(state, i, same)))

    def after(state: Column, i: Column, same: Column) -> Column:
        up, down = state["up"], state["down"]
        right = down.bitwiseOR(F.bitwise_not(same.bitwiseOR(up))).bitwiseAND(F.lit(mask))
        left = same.bitwiseAND(up)
        set_ = lambda bits, bit: F.when(bits.bitwiseAND(bit) != 0, F.lit(1)).otherwise(F.lit(0))
        slanted = i < F.size(long) - threshold
        distance = state["distance"] + F.when(slanted, 1 - set_(same, F.lit(top))).otherwise(set_(right, state["place"]) - set_(left, state["place"]))
        lower = F.shiftright(same, 1)
        return F.struct(
            left.bitwiseOR(F.bitwise_not(lower.bitwiseOR(right))).bitwiseAND(F.lit(mask)).alias("up"),
            lower.bitwiseAND(right).alias("down"),
            distance.alias("distance"),
            F.when(slanted, state["place"]).otherwise(F.shiftright(state["place"], 1)).alias("place"),
        )

    steps = F.when(F.size(short) > 0, F.sequence(F.lit(0), F.size(short) - 1)).otherwise(F.array().cast("array<int>"))
    result = F.aggregate(steps, start, step)["distance"]
    apart = F.size(long) - F.size(short)
    return F.when(apart > threshold, F.lit(threshold + 1)).otherwise(F.least(result, F.lit(threshold + 1)))


def _same(hit: Column, up: Column, down: Column, mask: int) -> Column:
    """Bits of the band's cells that equal their upper left neighbour."""
    return ((hit.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(hit).bitwiseOR(down).bitwiseAND(F.lit(mask))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(documents: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, mark, position and trimmed text of the lines of `least` characters or more."""
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), "text")
    rows = rows.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return rows.select("doc_id", "mark", "pos", _trimmed(F.col("raw")).alias("line")).where(F.length("line") >= least)


def _keys(line: Column, rest: bool = True) -> Column:
    """Segments that the line is indexed by, and those that it probes the next shorter lines with.

    With `rest`, also the other part of the line.
    """
    n = F.length(line)
    key = lambda size, segment, part: F.xxhash64(size, F.lit(segment), part)
    half = lambda size: F.floor(size / 2).cast("int")
    end = lambda size: F.right(line, size - half(size))
    item = lambda size, segment, part, indexed, other: F.struct(key(size, segment, part).alias("key"), F.lit(indexed).alias("indexed"), *([other.alias("rest")] if rest else []))
    return F.array(
        item(n, 1, F.left(line, half(n)), True, F.substring(line, half(n) + 1, n)),
        item(n, 2, end(n), True, F.left(line, half(n))),
        item(n - 1, 1, F.left(line, half(n - 1)), False, F.substring(line, half(n - 1) + 1, n)),
        item(n - 1, 2, end(n - 1), False, F.left(line, n - (n - 1 - half(n - 1)))),
    )


def _if_small(written_rows: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows, by count."""
    return F.broadcast(written_rows) if written_rows.count() <= BROADCAST_ROWS else written_rows


def _texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the distinct lines in ids."""
    rows = _lines(documents).select(F.xxhash64("line").alias("id"), "line").join(_if_small(ids), "id", "left_semi")
    return written(rows.groupBy("id").agg(F.min("line").alias("line")), "line-texts")


def _candidates(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of line ids that may be within one edit, and the lines' texts."""
    rows = _lines(documents).select(F.xxhash64("line").alias("id"), F.explode(_keys(F.col("line"), False)).alias("k"))
    each = rows.select("id", F.col("k.key").alias("key"), F.col("k.indexed").cast("int").alias("indexed"))
    buckets = each.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("indexed").alias("indexed"), F.count("*").alias("n"))
    buckets = written(buckets.where("a != b and indexed = 1"), "buckets")
    members = written(each.join(_if_small(buckets.select("key", "n")), "key").distinct(), "members")
    ids = written(members.select("id").distinct(), "ids")
    texts = _texts(documents, ids)
    small, large = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
    left = small.where("indexed = 1").select("key", F.col("id").alias("a"))
    right = small.select("key", F.col("id").alias("b"), "indexed")
    pairs = left.join(right, "key").where("a != b and (indexed = 0 or a < b)").select("a", "b")
    # in a large bucket: the rest of the line as it is, and without each of its characters
    named = large.select("key", "id").distinct().join(texts, "id")
    parts = named.select("key", "id", F.explode(_keys(F.col("line"))).alias("k")).where("k.key = key").select("key", "id", "k.indexed", "k.rest")
    finer = parts.select("key", "id", "indexed", F.explode(_shortened(F.col("rest"), F.col("indexed"))).alias("f")).select("key", "id", "indexed", "f.place", "f.part")
    centre = finer.where("indexed").groupBy("key", "place", "part").agg(F.min("id").alias("a"))
    stars = finer.select("key", "place", "part", F.col("id").alias("b")).join(centre, ["key", "place", "part"]).where("a != b").select("a", "b")
    pairs = pairs.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, texts


def _shortened(rest: Column, indexed: Column) -> Column:
    """Keys of a line's rest: without one character, with its place if indexed, and, if indexed, whole.

    The rest is seen in blocks of BLOCK characters: a key is made of what stands before and behind the
    character's block, and the block without it. The whole rest has a key for each block, as a line has
    that is one character longer.
    """
    at = lambda b: b * BLOCK
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(rest) - 1, F.lit(0)) / BLOCK).cast("int"))
    key = lambda place, before, inside, behind: F.struct(place.cast("int").alias("place"), F.xxhash64(before, inside, behind).alias("part"))

    def cut(b: Column) -> Column:
        own = F.substring(rest, at(b) + 1, F.lit(BLOCK))
        outer = F.struct(own.alias("own"), F.xxhash64(F.left(rest, at(b))).alias("before"), F.xxhash64(F.substring(rest, at(b) + BLOCK + 1, F.length(rest))).alias("behind"))
        places = lambda x: F.when(F.length(x["own"]) > 0, F.sequence(F.lit(1), F.length(x["own"]))).otherwise(F.array().cast("array<int>"))
        without = lambda x: F.transform(places(x), lambda p: key(F.when(indexed, at(b) + p).otherwise(-1 - b), x["before"], F.concat(F.left(x["own"], p - 1), F.substring(x["own"], p + 1, F.lit(BLOCK))), x["behind"]))
        return _let(outer, without)

    def whole(b: Column) -> Column:
        return key(-1 - b, F.xxhash64(F.left(rest, at(b))), F.substring(rest, at(b) + 1, F.lit(BLOCK - 1)), F.xxhash64(F.substring(rest, at(b) + BLOCK, F.length(rest))))

    # a line that is one character longer can have one block more
    more = F.sequence(F.lit(0), F.floor(F.length(rest) / BLOCK).cast("int"))
    none = F.array().cast("array<struct<place:int,part:bigint>>")
    return F.array_distinct(F.concat(F.flatten(F.transform(blocks, cut)), F.when(indexed, F.transform(more, whole)).otherwise(none)))


def near_lines(documents: DataFrame) -> DataFrame:
    """Verified links (a, b) between ids of distinct lines one edit apart."""
    pairs, texts = _candidates(documents)
    chars = lambda c, name: texts.select(F.col("id").alias(c), F.col("line").alias(name))
    both = pairs.join(chars("a", "x"), "a").join(chars("b", "y"), "b")
    longer = F.length("x") >= F.length("y")
    both = both.select("a", "b", F.split(F.when(longer, F.col("x")).otherwise(F.col("y")), "").alias("long"), F.split(F.when(longer, F.col("y")).otherwise(F.col("x")), "").alias("short"))
    return both.where(banded_distance(F.col("long"), F.col("short"), 1) <= 1).select("a", "b")


def _mark(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; such rows follow each other by it."""
    return F.pmod(F.xxhash64(text), F.lit(_MARKS)).cast("long")


def kept_lines(documents: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, mark, and the positions of those of its compared lines that are the first of their class."""
    row = (F.col("doc_id").cast("decimal(19,0)") * _MARKS + F.col("mark")).cast("decimal(29,0)")
    lines = _lines(documents, least).select(
        F.xxhash64("line").alias("id"), F.xxhash64(F.lit("second"), "line").alias("other"), (row * _LINES + F.col("pos")).cast("decimal(38,0)").alias("at")
    )
    distinct = lines.groupBy("id", "other").agg(F.min("at").alias("at"))
    named = components(written(near_lines(documents), "near-lines"))
    joined = distinct.join(named.withColumnRenamed("node", "id"), "id", "left")
    alone = joined.where("component is null").select("at")
    first = alone.union(joined.where("component is not null").groupBy("component").agg(F.min("at").alias("at")).select("at"))
    whole = F.lit(_LINES * _MARKS).cast("decimal(38,0)")
    rest = F.pmod("at", whole).cast("long")
    doc_id = ((F.col("at") - rest.cast("decimal(38,0)")) / whole).cast("long")
    placed = first.select(doc_id.alias("doc_id"), F.shiftright(rest, 31).alias("mark"), rest.bitwiseAND(F.lit(_LINES - 1)).cast("int").alias("pos"))
    return placed.groupBy("doc_id", "mark").agg(F.collect_list("pos").alias("kept"))


def deduplicated(documents: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """All columns, the text without repeated lines, and n_lines.

    Lines of `least` characters or more are compared for equality, those of MIN_CHARS or more for edits too.
    """
    kept, mark = free_name(documents, "kept"), free_name(documents, "mark")
    found = kept_lines(documents, least).withColumnsRenamed({"kept": kept, "mark": mark, "doc_id": mark + "_id"})
    rows = documents.withColumn(mark, _mark(F.col("text")))
    joined = rows.join(found, (rows["doc_id"] == found[mark + "_id"]) & (rows[mark] == found[mark]), "left").drop(found[mark])
    none = F.array().cast("array<int>")
    places = lambda x: F.when(F.size(x["lines"]) > 0, F.sequence(F.lit(0), F.size(x["lines"]) - 1)).otherwise(none)
    spared = lambda x: F.filter(places(x), lambda i: F.length(_trimmed(F.get(x["lines"], i))) < least)
    stays = lambda x: F.transform(F.sort_array(F.concat(spared(x), x["kept"])), lambda i: F.get(x["lines"], i))
    told = lambda x: F.struct(F.size(x["lines"]).cast("long").alias("n_lines"), F.array_join(stays(x), "\n").alias("text"))
    sizes = _let(F.struct(F.split("text", "\n").alias("lines"), F.coalesce(F.col(kept), none).alias("kept")), told)
    made = free_name(documents, "made")
    known = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    text = F.when(known, F.col(f"{made}.text")).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.col(f"{made}.n_lines")).cast("long")
    return joined.withColumn(made, sizes).select(*[text.alias("text") if c == "text" else F.col(c) for c in documents.columns], n_lines.alias(free_name(documents, "n_lines")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = deduplicated(documents, ALL_LINES)
    left = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select("doc_id", "n_lines", left.alias("n_left"), "text")
