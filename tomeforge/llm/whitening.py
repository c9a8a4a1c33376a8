"""Whitening of embeddings from an exact covariance, whose products are made of digit slices.

An entry c becomes the integer x = floor(1024 c) + 100000. A batch's integers are cut into limbs of LIMB
bits, the topmost with the sign; products of limb matrices are float64 matrix products (BLAS) and exact,
since a batch has at most ROWS rows and so each sum stays below 2^53. Limb products are recombined as big
integers, added up within a task and then, as decimals in places of PLACE bits, by one aggregation over
all tasks. The driver gets the d (d + 1) / 2 sums of products and d sums of the dimensions, whatever the
number of rows. From these the covariance is a quotient of exact integers, (n G - S S') / n^2, that is
centred before anything is rounded; it is decomposed in float64, and values and vectors are refined in
extended precision. A second pass gives whitened's own covariance, a third the rows.

Rows without a vector, or with null or non-finite entries, are dropped; a null vec_id, repeated rows and ties stay
rows like any other. Vectors of another length have no covariance with these: each length is a fit
list of its own, with its own n. Components beyond the length don't exist, so empty vectors have no
rows, nor has an empty table. A component without variance (all rows alike in it) has `explained` 0 and a
null `whitened`, and is no part of `identity_error`, which is null if no component has variance. Entries
beyond 2^62 after scaling count as 2^62. `deviation` is null where the exact sum doesn't fit (a long in
op11_whitening, 38 digits in whitened()). Equal eigenvalues have some basis, the same for all rows.
Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.tables import mapped, table

SCALE, SHIFT, FAR = 1024, 100_000, 1 << 62
#: Bits of a limb, rows of one product (2^LIMB * 2^LIMB * ROWS = 2^53), bits of a place of the merged sums.
LIMB, ROWS, PLACE = 18, 1 << 17, 96
COMPONENTS = 8
#: An eigenvalue below this share of the trace is rounding: the component has no variance.
NOTHING = 1e-15
#: Numbers that a task holds back, so that limb products are recombined once for many batches.
HELD = 1 << 21


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector and its length, of the rows that remain."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite) & (F.size("vector") > 0)).withColumn("length", F.size("vector"))


def integers(vectors: np.ndarray) -> np.ndarray:
    """x of each entry, as int64."""
    scaled = np.floor(vectors * SCALE)
    return np.where(scaled >= FAR, FAR, np.where(scaled <= -FAR, -FAR, scaled)).astype(np.int64) + SHIFT


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float64 limbs of int64 values, lowest first; the last carries the sign. Only as many as the values need."""
    out, low = [], (1 << LIMB) - 1
    while len(x) and (x.min() < -(1 << (LIMB - 1)) or x.max() >= 1 << LIMB):
        out.append((x & low).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """x' x as exact Python integers, by float64 products of limbs."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for at in range(0, len(x), ROWS):
        slices = limbs(x[at : at + ROWS])
        for i, a in enumerate(slices):
            for j, b in enumerate(slices[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
                total += product if i == j else product + product.T
    return total


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(length, places, vectors) of a batch's lengths."""
    lengths = batch.column("length").to_numpy(zero_copy_only=False)
    vectors = batch.column("vector")
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        own = vectors if len(at) == len(lengths) else vectors.take(pa.array(at))
        yield int(length), at, np.asarray(own.flatten(), dtype=np.float64).reshape(-1, int(length))


def _places(value: int) -> list[tuple[int, Decimal]]:
    """A big integer as digits of PLACE bits, the last one signed; together they add up to it."""
    out, place = [], 0
    while not -(1 << PLACE) <= value < 1 << PLACE:
        out.append((place, Decimal(value & ((1 << PLACE) - 1))))
        value >>= PLACE
        place += 1
    return [*out, (place, Decimal(value))]


def sums(rows: DataFrame) -> DataFrame:
    """(length, i, j, place, value): value 2^(PLACE place), summed over places, is the sum of x_i x_j; j = -1: of x_i; i = j = -1: of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def recombined(own: list) -> None:
            if own[3]:
                x = np.concatenate(own[3])
                own[0] += len(x)
                own[1] = own[1] + (x.astype(object).sum(axis=0) if abs(x).max() >= 1 << 40 else x.sum(axis=0).astype(object))
                own[2] = own[2] + gram(x)
                own[3].clear()

        for batch in batches:
            for length, _, vectors in _by_length(batch):
                own = held.setdefault(length, [0, 0, 0, []])
                own[3].append(integers(vectors))
                if sum(x.size for x in own[3]) >= HELD:
                    recombined(own)
        for own in held.values():
            recombined(own)
        for length, (n, total, products, _) in held.items():
            listed = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(total)), *((i, j, products[i, j]) for i in range(length) for j in range(i + 1))]
            out = [(length, i, j, place, digits) for i, j, value in listed for place, digits in _places(int(value))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(30, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["length", "i", "j", "place", "value"])

    parts = mapped(rows.select("vector", "length"), run, "length int,i int,j int,place int,value decimal(30,0)")
    return parts.groupBy("length", "i", "j", "place").agg(F.sum("value").alias("value"))


def _extended(value: int) -> np.longdouble:
    return np.longdouble(str(value))


def decomposed(covariance: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors of covariance / scale, given as Python integers.

    Float64 first; then each round takes the vectors' products with the matrix in extended precision, and
    corrects them by what is left beside the diagonal.
    """
    exact = np.array([[_extended(v) for v in row] for row in covariance]) / _extended(scale)
    values, vectors = np.linalg.eigh(exact.astype(np.float64))
    vectors = vectors.astype(np.longdouble)
    for _ in range(3):
        off = np.eye(len(vectors), dtype=np.longdouble) - vectors.T @ vectors
        turned = vectors.T @ exact @ vectors
        values = np.diag(turned) / (1 - np.diag(off))
        gap = values[None, :] - values[:, None]
        # values too near for a direction of their own keep the one they have
        near = np.abs(gap) <= 1e-12 * max(np.abs(values).max(), np.finfo(float).tiny)
        step = np.where(near, off / 2, (turned + values[None, :] * off) / np.where(near, 1, gap))
        vectors = vectors + vectors @ step
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.sqrt((vectors[:, order] ** 2).sum(axis=0))
    return values[order].astype(np.float64), vectors.astype(np.float64)


class Whitener:
    """What one length's rows need: n, S, components with their values, and the trace."""

    def __init__(self, found: dict[tuple[int, int], int], length: int, components: int):
        self.n = found[-1, -1]
        self.sums = np.array([found[i, -1] for i in range(length)], dtype=object)
        products = np.array([[found[max(i, j), min(i, j)] for j in range(length)] for i in range(length)], dtype=object).reshape(length, length)
        centred = self.n * products - np.outer(self.sums, self.sums)
        trace = int(np.trace(centred))
        values, vectors = decomposed(centred, self.n * self.n)
        self.values, self.vectors = values[:components], vectors[:, :components]
        total = trace / (self.n * self.n)
        self.has = self.values > NOTHING * total if trace else np.zeros(len(self.values), dtype=bool)
        self.explained = np.where(self.has, self.values, 0.0) / (total or 1.0)
        self.small = max((abs(int(s)) for s in self.sums), default=0) < 1 << 61

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where that holds it, else Python integers."""
        if self.small and len(x) and self.n * (abs(x).max().item() + 1) < 1 << 61:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def deviations(self, apart: np.ndarray) -> list[int]:
        if apart.dtype != object and len(apart) and (abs(apart).max().item() ** 2) * apart.shape[1] < 1 << 62:
            return (apart * apart).sum(axis=1).tolist()
        return [sum(int(v) ** 2 for v in row) for row in apart]

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        scale = np.where(self.has, np.sqrt(np.where(self.has, self.values, 1.0)), np.nan)
        return (apart / self.n).astype(np.float64) @ self.vectors / scale


def fitted(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A Whitener for each length; `rows` come from usable()."""
    found: dict[int, dict] = {}
    for r in sums(rows).toLocalIterator():  # d (d + 1) / 2 + d + 1 sums of each length
        own = found.setdefault(r["length"], {})
        own[r["i"], r["j"]] = own.get((r["i"], r["j"]), 0) + (int(r["value"]) << PLACE * r["place"])
    return {length: Whitener(own, length, components) for length, own in found.items()}


def identity_error(rows: DataFrame, sent, components: int) -> float | None:
    """The largest absolute entry of whitened's covariance minus the identity, over all rows and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, vectors in _by_length(batch):
                fit = sent.value[length]
                white = fit.whitened(fit.apart(integers(vectors)))
                padded = np.full((len(white), components), np.nan)
                padded[:, : white.shape[1]] = white
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(white), length), pa.int32()), *(pa.array(c, pa.float64()) for c in padded.T)], ["length", *(f"w{i}" for i in range(components))])

    names = [f"w{i}" for i in range(components)]
    made = mapped(rows.select("vector", "length"), run, ",".join(["length int", *(f"{w} double" for w in names)]))
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    # covar_pop centres on running means and merges them, so nothing is cancelled
    known = made.groupBy("length").agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).collect()  # a row for each length
    errors = []
    for r in known:
        has = sent.value[r["length"]].has
        errors += [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i < len(has) and has[i] and has[j]]
    return max(errors, default=None)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, length, component, n, deviation (38 digits), whitened, explained and identity_error of each row and component."""
    rows = usable(embeddings)
    sent = embeddings.sparkSession.sparkContext.broadcast(fitted(rows, components))  # numbers of d (components + 1) for each length
    error = identity_error(rows, sent, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, vectors in _by_length(batch):
                fit = sent.value[length]
                apart = fit.apart(integers(vectors))
                white = fit.whitened(apart)
                k = white.shape[1]
                deviation = [Decimal(v) if v < 10**38 else None for v in fit.deviations(apart)]
                flat = white.ravel()
                repeated = pa.array(np.repeat(np.arange(len(at)), k))
                ids = batch.column("vec_id").take(pa.array(at)).take(repeated)
                columns = [
                    ids, pa.array(np.full(len(flat), length), pa.int32()), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(flat), fit.n), pa.int64()),
                    pa.array(deviation, pa.decimal128(38, 0)).take(repeated), pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(np.tile(fit.explained, len(at)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "length", "component", "n", "deviation", "whitened", "explained"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = mapped(rows, run, f"vec_id {kind},length int,component int,n long,deviation decimal(38,0),whitened double,explained double")
    return out.withColumn("identity_error", F.lit(error).cast("double"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
