"""Hard negatives of anchors, filtered by product quantisation with stored residual norms.

Components become integers, floor(256 x). A vector is cut into pairs of dimensions; each pair has a
codebook of at most CENTROIDS integer centroids, and a row stores the nearest one of each pair and the
norm of what is left, rounded up. An anchor's inner product with the centroids comes from a table of
its products with all centroids, looked up by code. By Cauchy and Schwarz the true product differs from it by at most the
anchor's norm times the stored one. With these bounds a block of rows gives, for each anchor,

- as positives every row of its label whose upper bound reaches the block's fifth lower bound, and then
- as negatives of each positive every row of another label whose bounds meet the window of scores and
  whose upper bound reaches the third lower bound of those that are surely inside.

Only these are multiplied out, in exact integers; the block's first five, or three, go on to a merge of
all blocks. So no row is lost, however coarse the codes are. Codebooks are fitted on SAMPLE rows at
most; lengths that the sample lacks have a zero centroid, with which the bounds still hold.

Rows are dealt by hash into blocks of about BLOCK rows, anchors into blocks of the same size; each block
of anchors meets each block of rows in one task. A label with a third of all rows is spread over all
blocks. Work and, beyond one block of anchors, the rows' copies grow with the product of both numbers,
as each anchor must be held against every row.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Equal rows count once;
different rows with one vec_id are rows of their own, but none is a positive or negative of its own vec_id. Scores tie by
smaller vec_id, then by label and vector. Vectors of different lengths have no inner product; empty ones
have the product 0. Entries beyond 2^26 after scaling count as 2^26, so that the products of up to 2,047
dimensions fit a long. Without anchors, positives or negatives there are no rows. Only vec_id, label and embedding
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.llm.samples import hashed_sample
from tomeforge.llm.tables import mapped, table, written

SCALE, FAR = 256, 1 << 26
#: Dimensions that share a codebook, its centroids, rows that codebooks are fitted on, steps of the fit.
PAIR, CENTROIDS, SAMPLE, STEPS = 2, 256, 8192, 6
#: Rows, or anchors, of a block at most, and at least where there are more tasks than blocks. Anchors looked up at once.
BLOCK, LEAST_BLOCK, AT_ONCE = 1 << 16, 1 << 12, 32
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
EVERY = 50
ENTRY = "vec_id long,label long,mark long,length int,x array<int>,codes binary,residual double,is_anchor boolean"


def usable(embeddings: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """Rows that take part, each once, with the label given, integer components and a mark that tells rows of one vec_id apart."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = embeddings.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    whole = lambda x: F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), F.floor(x * SCALE).cast("double"))).cast("int")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("vector", whole).alias("x"), "is_anchor")
    return rows.dropDuplicates(["vec_id", "label", "x"]).withColumn("mark", F.xxhash64("label", "x")).withColumn("length", F.size("x"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.int64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), width)


class Codebooks:
    """Integer centroids of each pair of dimensions."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.books = [self._fitted(sample[:, at : at + PAIR], rng) for at in range(0, sample.shape[1], PAIR)]

    @staticmethod
    def _fitted(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        rows = np.unique(x, axis=0)
        if not len(rows):
            return np.zeros((1, x.shape[1]), dtype=np.int64)
        centres = rows[rng.permutation(len(rows))[:CENTROIDS]].astype(np.float64)
        for _ in range(STEPS if len(rows) > CENTROIDS else 0):
            own = _nearest(x, centres)
            count = np.bincount(own, minlength=len(centres))
            for d in range(x.shape[1]):
                total = np.bincount(own, weights=x[:, d], minlength=len(centres))
                centres[:, d] = np.where(count, total / np.maximum(count, 1), centres[:, d])
        return np.rint(centres).astype(np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and norms of the residuals, not below the true ones."""
        codes, left = np.empty((len(x), len(self.books)), dtype=np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = x[:, m * PAIR : (m + 1) * PAIR]
            codes[:, m] = _nearest(part, book)
            left += ((part - book[codes[:, m]]).astype(np.float64) ** 2).sum(axis=1)
        return codes, np.sqrt(left) * (1 + 1e-9)

    def looked_up(self, codes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """(rows, anchors): products of the anchors with the rows' centroids."""
        total = np.zeros((len(codes), len(anchors)))
        for m, book in enumerate(self.books):
            products = book.astype(np.float64) @ anchors[:, m * PAIR : (m + 1) * PAIR].T.astype(np.float64)
            total += products[codes[:, m]]
        return total


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own, size = np.empty(len(x), dtype=np.int64), (centres.astype(np.float64) ** 2).sum(axis=1)
    for at in range(0, len(x), 4096):
        own[at : at + 4096] = (size - 2.0 * x[at : at + 4096].astype(np.float64) @ centres.T.astype(np.float64)).argmin(axis=1)
    return own


def encoded(rows: DataFrame) -> DataFrame:
    """ENTRY for rows of usable(): with codes and residual norms; the codebooks, by length, are its attribute `books`."""
    sample: dict[int, list] = {}
    for r in hashed_sample(rows.select("vec_id", "x"), "vec_id", SAMPLE).collect():
        sample.setdefault(len(r.x), []).append(r.x)
    books = rows.sparkSession.sparkContext.broadcast({n: Codebooks(np.array(x, dtype=np.int64)) for n, x in sample.items() if n})  # at most 256 centroids a pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == n)))
                x = _matrix(part.column("x"), n)
                codes, residual = _books(books, n).encode(x)
                data = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "label", "mark", "length", "x")), data, pa.array(residual, pa.float64()), part.column("is_anchor")], ENTRY_NAMES)

    out = written(mapped(rows.select("vec_id", "label", "mark", "length", "x", "is_anchor"), run, ENTRY), "codes")
    out.books = books
    return out


ENTRY_NAMES = [field.split()[0] for field in ENTRY.split(",")]


def _books(sent, length: int) -> Codebooks:
    return sent.value[length] if length in sent.value else Codebooks(np.zeros((0, length), dtype=np.int64))


class _Block:
    """A block of rows, in order of label, with what bounds and exact products need."""

    def __init__(self, rows: pa.Table, books: Codebooks, length: int):
        rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("mark", "ascending")])
        self.ids, self.labels, self.marks = (rows.column(c).to_numpy() for c in ("vec_id", "label", "mark"))
        self.x = _matrix(rows.column("x"), length)
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(rows), -1) if length else np.zeros((len(rows), 0), np.uint8)
        self.residual, self.books = rows.column("residual").to_numpy(), books
        self.norm = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))

    def bounds(self, anchors: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, rows) least and greatest products of the anchors with some rows."""
        sizes = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        near = self.books.looked_up(self.codes[some], anchors).T
        # the last term is more than sums of doubles are rounded by
        slack = sizes[:, None] * self.residual[None, some] * (1 + 1e-9) + 1e-12 * (self.norm + self.residual.max(initial=0.0)) * sizes[:, None] * (anchors.shape[1] + 1)
        return near - slack, near + slack

    def exact(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.x[at] @ anchor

    def first(self, at: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """The order of the first rows: by falling score, then by id, label and mark."""
        return np.lexsort((self.marks[at], self.labels[at], self.ids[at], -scores))[:most]


def _greatest(values: np.ndarray, k: int) -> float:
    """The k-th greatest value; minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _near(block: _Block, anchors: pa.Table, length: int, k: int) -> Iterator[tuple]:
    """(anchor's place, row's place, score) of each anchor's first k rows of its label in the block."""
    ids, labels, x = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("x"), length)
    order = np.argsort(labels, kind="stable")
    for label in np.unique(labels):
        some = slice(int(np.searchsorted(block.labels, label)), int(np.searchsorted(block.labels, label, "right")))
        own = order[np.searchsorted(labels[order], label) : np.searchsorted(labels[order], label, "right")]
        for at in range(0, len(own) if some.stop > some.start else 0, AT_ONCE):
            part = own[at : at + AT_ONCE]
            for i, low, high in zip(part, *block.bounds(x[part], some), strict=True):
                other = block.ids[some] != ids[i]
                open_ = some.start + np.flatnonzero(other & (high >= _greatest(low[other], k)))
                scores = block.exact(open_, x[i])
                for j in block.first(open_, scores, k):
                    yield int(i), int(open_[j]), int(scores[j])


def _inside(block: _Block, anchors: pa.Table, length: int, k: int) -> Iterator[tuple]:
    """(anchor's place, place in its list of positives, row's place, score) of the first k rows of other labels in each window."""
    ids, labels, x = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("x"), length)
    windows = anchors.column("scores").to_pylist()
    for at in range(0, len(ids), AT_ONCE):
        for i, low, high in zip(range(at, len(ids)), *block.bounds(x[at : at + AT_ONCE], slice(0, len(block.ids))), strict=False):
            other = (block.labels != labels[i]) & (block.ids != ids[i])
            for place, score in enumerate(windows[i]):
                least, most = -(-LOW * score // 100), HIGH * score // 100
                if least > most:
                    continue
                open_ = other & (high >= least) & (low <= most)
                sure = _greatest(low[open_ & (low >= least) & (high <= most)], k)
                found = np.flatnonzero(open_ & (high >= sure))
                scores = block.exact(found, x[i])
                inside = (scores >= least) & (scores <= most)
                found, scores = found[inside], scores[inside]
                for j in block.first(found, scores, k):
                    yield int(i), place, int(found[j]), int(scores[j])


def _blocks(spark: SparkSession, rows: int) -> int:
    """Blocks of BLOCK rows, or smaller ones as long as there are tasks for them."""
    return max(1, -(-rows // BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-rows // LEAST_BLOCK)))


def _met(entries: DataFrame, anchors: DataFrame, books, blocks: tuple[int, int], find, k: int, added: str, taken) -> DataFrame:
    """find() over each block of anchors and each block of rows; taken(anchors, block, found) gives the columns."""
    per_row, per_anchor = blocks
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("anchor_block", deal(per_anchor)).withColumn("block", all_(per_row))
    right = entries.select(*(F.col(c).alias(c) for c in ENTRY_NAMES[:-1])).withColumn("block", deal(per_row)).withColumn("anchor_block", all_(per_anchor))
    key = ["length", "block", "anchor_block"]
    names = [field.split()[0] for field in added.split(",")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        length = left.column("length")[0].as_py()
        block = _Block(right, _books(books, length), length)
        found = [np.array(c, dtype=np.int64) for c in zip(*find(block, left, length, k), strict=True)]
        return pa.table(dict(zip(names, taken(left, block, found), strict=True)), empty.schema) if found else empty

    empty = pa.schema([(n, pa.int64()) for n in names]).empty_table()
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, added)


def positives(entries: DataFrame, anchors: DataFrame, blocks: tuple[int, int], k: int = POSITIVES) -> DataFrame:
    """(anchor_id, anchor_mark, positive_id, positive_mark, score): each anchor's first k rows of its label."""

    def taken(left: pa.Table, block: _Block, found: list) -> list:
        i, j, score = found
        return [left.column("vec_id").to_numpy()[i], left.column("mark").to_numpy()[i], block.ids[j], block.marks[j], score]

    rows = _met(entries, anchors, entries.books, blocks, _near, k, "anchor_id long,anchor_mark long,positive_id long,positive_mark long,score long", taken)
    order = Window.partitionBy("anchor_id", "anchor_mark").orderBy(F.desc("score"), "positive_id", "positive_mark")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mined(embeddings: DataFrame, label: Column, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and the marks of the three rows."""
    spark = embeddings.sparkSession
    entries = encoded(usable(embeddings, label, is_anchor))
    anchors = entries.where("is_anchor").select("vec_id", "mark", "label", "length", "x")
    blocks = _blocks(spark, entries.count()), max(1, -(-anchors.count() // BLOCK))
    near = written(positives(entries, anchors, blocks, n_positives), "positives")
    listed = near.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_mark").alias("mark")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_mark", "score"))).alias("near"))  # n_positives at most
    listed = listed.select("vec_id", "mark", F.col("near.positive_id").alias("positives"), F.col("near.positive_mark").alias("positive_marks"), F.col("near.score").alias("scores"))

    def taken(left: pa.Table, block: _Block, found: list) -> list:
        i, place, j, score = found
        held = [left.column(c).to_pylist() for c in ("positives", "positive_marks", "scores")]
        return [left.column("vec_id").to_numpy()[i], left.column("mark").to_numpy()[i], *([c[a][b] for a, b in zip(i, place, strict=True)] for c in held), block.ids[j], block.marks[j], block.labels[j], score]

    names = "anchor_id long,anchor_mark long,positive_id long,positive_mark long,positive_score long,negative_id long,negative_mark long,negative_label long,negative_score long"
    rows = _met(entries, anchors.join(listed, ["vec_id", "mark"]), entries.books, blocks, _inside, n_negatives, names, taken)
    order = Window.partitionBy("anchor_id", "anchor_mark", "positive_id", "positive_mark").orderBy(F.desc("negative_score"), "negative_id", "negative_label", "negative_mark")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).drop("negative_label")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = mined(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % EVERY == 0)
    return rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
