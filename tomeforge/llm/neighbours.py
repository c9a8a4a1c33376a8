"""Approximate nearest neighbours by largest inner product, with an inverted multi-index.

Vectors are cut into two halves, each with its own codebook; a pair of centroids is a cell. For a
query, cells are met in order of their two summed distances (here: falling summed inner products)
until the cells hold a share of all rows; their entries are reranked by exact inner products in double
precision. The traversal keeps a heap over pairs of runs of STEP centroids, by the best sum that a run's
cell can have: when the best sum left is below that of enough rows, no cell is missed, so that the
cells are those that single steps would give.

Codebooks (about 2 sqrt(N) centroids, MOST_CENTROIDS at most) and share are fitted on a bounded
sample of SAMPLE rows: the share is the least of SHARES at which neighbours of a part of the sample
that the codebooks have not seen are found with a recall of TARGET. All rows are indexed.

Work is dealt in blocks of VALUES numbers: entries by groups of first centroids that lie side by side,
a centroid with more rows being several groups; queries by hash. A query goes to the groups in which one
of its cells can be. A cell with a third of all rows is many blocks, and no group is unbounded.

Vectors that are null, zero, or with null or non-finite components take no part, nor do rows without
vec_id. Vectors of different lengths have no inner product: each length is searched by itself. A
query's own row, and rows that repeat its vec_id, aren't its candidates. A vec_id is listed once, by
its best row, however often it is repeated; a query whose id has several vectors is asked with each. Scores
are summed component by component, so they don't depend on the blocks. Without any vector the
result is empty. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.llm.samples import hashed_sample
from tomeforge.llm.tables import mapped, table, written

MOST_CENTROIDS, SAMPLE, STEP = 1024, 32768, 32
#: Numbers in a block of entries, or of queries, at most (8 bytes each).
VALUES = 1 << 20
SHARES, TARGET = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0), 0.94
#: Rows of the sample that the fit asks for, and that it keeps from the codebooks.
ASKED = 200
K, LEAST = 20, 400
EVERY = 20
FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means with a few steps, in order of the first principal axis; at most as many centroids as distinct rows."""
    rows = np.unique(x, axis=0)
    centres = rows[rng.permutation(len(rows))[:k]]
    if not centres.shape[1]:
        return centres
    for _ in range(8):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], starts) / np.diff(np.append(starts, len(x)))[:, None]
    axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    return centres[np.argsort(centres @ axis, kind="stable")]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = np.empty(len(x), dtype=np.int32)
    size = (centres**2).sum(axis=1)[None, :]
    for at in range(0, len(x), 4096):
        own[at : at + 4096] = (size - 2 * x[at : at + 4096] @ centres.T).argmin(axis=1)
    return own


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of x and y, summed component by component: the same at every block size."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


class MultiIndex:
    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        """rows: how many the index will hold."""
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.cut = self.dim // 2
        sample = sample[rng.permutation(len(sample))]
        unseen = sample[: ASKED if len(sample) > 10 * ASKED else 0]
        seen = sample[len(unseen) :]
        k = max(1, min(MOST_CENTROIDS, int(2 * rows**0.5), len(seen) // 8 + 1))
        self.books = [_codebook(x, k, rng) for x in (seen[:, : self.cut], seen[:, self.cut :])]
        self.share = self._share(unseen if len(unseen) else seen[:ASKED], sample)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, : self.cut], self.books[0]), _nearest(x[:, self.cut :], self.books[1])

    def counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)
        np.add.at(out, (first, second), 1)
        return out

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The query's inner products with both codebooks."""
        return tuple((book * half).sum(axis=1) for book, half in zip(self.books, (query[: self.cut], query[self.cut :]), strict=True))

    def least_sum(self, query: np.ndarray, counts: np.ndarray, wanted: float) -> float:
        """The summed inner product down to which cells are visited: they hold `wanted` rows, or all."""
        a, b = self.scores(query)
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, counts = a[by_a], b[by_b], counts[by_a][:, by_b]
        heap, pushed = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
        sums, held, inside, check = [], [], 0, 0
        while heap:
            _, i, j = heapq.heappop(heap)
            n = counts[i : i + STEP, j : j + STEP]
            some = n > 0
            sums.append((a[i : i + STEP, None] + b[None, j : j + STEP])[some])
            held.append(n[some])
            inside += int(held[-1].sum())
            for x, y in ((i + STEP, j), (i, j + STEP)):
                if x < len(a) and y < len(b) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (-(a[x] + b[y]), x, y))
            if inside >= wanted and len(sums) >= check:
                # cells of runs that aren't met can be as good as `left`; those above it are all here
                left = -heap[0][0] if heap else -np.inf
                if sum(int(n[s >= left].sum()) for s, n in zip(sums, held, strict=True)) >= wanted:
                    break
                check = len(sums) * 9 // 8
        s, n = np.concatenate(sums), np.concatenate(held)
        order = np.argsort(-s, kind="stable")
        return float(s[order][np.searchsorted(np.cumsum(n[order]), wanted)]) if inside > wanted else -np.inf

    def _share(self, queries: np.ndarray, sample: np.ndarray) -> float:
        first, second = self.cells(sample)
        found = np.zeros(len(SHARES))
        for q in queries:
            own = np.argsort(-(sample @ q), kind="stable")[1 : K + 1]
            a, b = self.scores(q)
            sums = a[first] + b[second]
            down_to = np.sort(sums)[::-1]
            if not len(own):  # nothing but the query itself: every share finds it all
                found += 1
                continue
            for i, share in enumerate(SHARES):
                found[i] += (sums[own] >= down_to[max(0, int(share * len(sums)) - 1)]).mean()
        return next((share for share, n in zip(SHARES, found, strict=True) if n >= TARGET * len(queries)), 1.0)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, the vector and its length, of rows that take part, each once."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    rows = rows.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "vector"]).select("vec_id", "vector", F.size("vector").alias("length"))


def _groups(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each first centroid, about `size` rows or less together, and the number of blocks of each group."""
    rows = counts.sum(axis=1)
    group, blocks, held = np.zeros(len(rows), dtype=np.int64), [], 0
    for i, n in enumerate(rows):
        if not blocks or held + n > size:
            blocks.append(0)
            held = 0
        group[i] = len(blocks) - 1
        held += n
        blocks[-1] = max(1, -(-int(held) // size))
    return group, np.array(blocks, dtype=np.int64)


def _found(rows: DataFrame, is_query, k: int) -> DataFrame:
    """FOUND for rows of one length: k candidates of each query and block at least, if there are so many."""
    spark = rows.sparkSession
    total = rows.count()
    sample = [r.vector for r in hashed_sample(rows, "vec_id", SAMPLE).collect()]
    index = MultiIndex(np.array(sample, dtype=np.float64), total)
    dim = index.dim
    size = max(256, VALUES // dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = index.cells(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], [*batch.schema.names, "first", "second"])

    placed = written(mapped(rows.select("vec_id", "vector"), place, "vec_id long, vector array<double>, first int, second int"), "cells")
    counts = np.zeros((len(index.books[0]), len(index.books[1])), dtype=np.int64)
    for r in placed.groupBy("first", "second").count().toLocalIterator():  # MOST_CENTROIDS ** 2 rows at most
        counts[r["first"], r["second"]] = r["count"]
    wanted = max(LEAST, index.share * total)
    group, blocks = _groups(counts, size)
    queries = placed.where(is_query)
    parts = max(1, -(-queries.count() // size))
    sent = spark.sparkContext.broadcast((index, counts, group, blocks))  # bounded by MOST_CENTROIDS and SAMPLE

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, group, blocks = sent.value
        filled = [np.flatnonzero(counts.any(axis=1)), np.flatnonzero(counts.any(axis=0))]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("vector"), dim), strict=True):
                least = index.least_sum(vector, counts, wanted) - 1e-9
                a, b = index.scores(vector)
                for g in np.unique(group[filled[0][a[filled[0]] + b[filled[1]].max() >= least]]).tolist():
                    for block in range(blocks[g]):
                        for c, x in zip(out, (vec_id, vector, least, g, block), strict=True):
                            c.append(x)
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vector", "least", "group", "block"])

    spread = lambda id_, vector, n: F.pmod(F.xxhash64(id_, vector), n).cast("int")
    asked = mapped(queries.select("vec_id", "vector"), route, "query_id long, vector array<double>, least double, group int, block int")
    asked = asked.withColumn("part", spread("query_id", "vector", F.lit(parts)))
    groups = spark.createDataFrame([(i, int(g), int(blocks[g])) for i, g in enumerate(group)], "first int, group int, blocks int")
    dealt = placed.join(F.broadcast(groups), "first")  # MOST_CENTROIDS rows at most
    dealt = dealt.select("vec_id", "vector", "first", "second", "group", spread("vec_id", "vector", F.col("blocks")).alias("block"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["group", "block", "part"]

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores, owners = [], [], []
        if left.num_rows and right.num_rows:
            index = sent.value[0]
            right = right.sort_by("vec_id")
            own, starts = np.unique(right.column("vec_id").to_numpy(), return_index=True)
            first, second = (right.column(c).to_numpy() for c in ("first", "second"))
            vectors, asked_ids, wide = _matrix(right.column("vector"), dim), left.column("query_id").to_numpy(), _matrix(left.column("vector"), dim)
            least = left.column("least").to_numpy()
            longest = np.linalg.norm(vectors, axis=1).max()
            row_of = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(vectors))))
            for at in range(0, len(asked_ids), 64):
                some = slice(at, at + 64)
                near = wide[some] @ vectors.T
                a, b = (half @ book.T for half, book in zip((wide[some, : index.cut], wide[some, index.cut :]), index.books, strict=True))
                near[a[:, first] + b[:, second] < least[some, None] - 1e-9] = -np.inf
                for n, value in enumerate(near):
                    i = int(np.searchsorted(own, asked_ids[at + n]))
                    if i < len(own) and own[i] == asked_ids[at + n]:
                        value[row_of == i] = -np.inf
                    best = np.maximum.reduceat(value, starts)  # of an id's rows
                    bound = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else -np.inf
                    slack = 1e-12 * dim * longest * np.linalg.norm(wide[at + n])  # more than orders of summing can differ
                    open_ = np.flatnonzero((value >= bound - slack) & (value > -np.inf))
                    exact = products(vectors[open_], np.broadcast_to(wide[at + n], (len(open_), dim)))
                    order = np.lexsort((own[row_of[open_]], -exact))
                    listed, place = np.unique(own[row_of[open_]][order], return_index=True)
                    place = np.sort(place)[:k]
                    ids.append(own[row_of[open_]][order][place])
                    scores.append(exact[order][place])
                    owners.append(np.full(len(place), asked_ids[at + n]))
        parts_ = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owners, np.int64), (ids, np.int64), (scores, np.float64))]
        return pa.table({"query_id": pa.array(parts_[0], pa.int64()), "vec_id": pa.array(parts_[1], pa.int64()), "score": pa.array(parts_[2], pa.float64())})

    return asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(rerank, FOUND)


def neighbours(embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """The k nearest of each row for which the column expression is_query, on vec_id, holds."""
    rows = written(usable(embeddings), "vectors")
    lengths = [r["length"] for r in rows.select("length").distinct().orderBy("length").collect()]  # of vectors: a few
    if not lengths:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.union, [_found(rows.where(F.col("length") == n), is_query, k) for n in lengths])
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
