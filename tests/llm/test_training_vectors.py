from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeforge.llm import hard_negatives, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def exact_covariance(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return sums, [[sum(Fraction(n * r[i] - sums[i], n) * Fraction(n * r[j] - sums[j], n) for r in x) / n for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("low, high", [(0, 2), (-5, 5), (-(1 << 17), 1 << 18), (-(1 << 40), 1 << 40), (-(1 << 62), 1 << 62)])
def test_limb_products_are_exact(low, high):
    x = np.random.default_rng(3).integers(low, high, size=(700, 5))
    slices = whitening.limbs(x)
    assert (sum(s.astype(object).astype(int).astype(object) << whitening.LIMB * i for i, s in enumerate(slices)) == x).all()
    assert all(abs(s).max() <= 1 << whitening.LIMB for s in slices)
    wide = x.astype(object)
    assert (whitening.gram(x) == wide.T @ wide).all()


@pytest.mark.parametrize("value", [0, -1, 5, 1 << 95, -(1 << 96), (1 << 200) + 12345, -(1 << 200) - 9])
def test_places_add_up(value):
    assert sum(int(digits) << whitening.PLACE * place for place, digits in whitening._places(value)) == value


def test_decomposition_of_a_graded_matrix():
    """Eigenvalues of very different sizes, which float64 alone gets wrong by more than they are."""
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    a = np.array([[int(v) for v in row] for row in np.rint(q * 1000)], dtype=object)
    wanted = [10**26, 10**13, 10**9, 10**5, 50, 1]
    matrix = a @ np.diag(np.array(wanted, dtype=object)) @ a.T
    values, vectors = whitening.decomposed(matrix, 10**6)
    inverse = [Fraction(int(v)) for v in (vectors[:, 0] * 2**50).astype(int)]
    ray = sum(inverse[i] * int(matrix[i, j]) * inverse[j] for i in range(6) for j in range(6)) / sum(v * v for v in inverse) / 10**6
    assert abs(float(ray) / values[0] - 1) < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-14
    assert (np.diff(values) <= 0).all()


def test_whitening_against_exact_fractions(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in rng.normal(size=5) * (1, 30, 0.2, 5, 3) + (0, 9, -4, 0, 1)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, NAN, 0.0, 0.0, 0.0]), (102, [INF, 0.0, 0.0, 0.0, 0.0]), (103, [None, 0.0, 0.0, 0.0, 0.0]), (104, []), (3, rows[3][1]), (None, [1.5] * 5)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("length", F.lit("x")).repartition(3)
    got = whitening.whitened(frame, 3).collect()
    kept = [(i, v) for i, v in rows + odd if v and all(c is not None and abs(c) < INF for c in v)]
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept]
    sums, covariance = exact_covariance(x)
    n, v = len(x), np.array(covariance, dtype=float)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:3], vectors[:, ::-1][:, :3]
    white = (np.array(x, dtype=float) - np.array(sums, dtype=float) / n) @ vectors / np.sqrt(values)
    wanted = sorted(((-1 if i is None else i), c + 1, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)), abs(white[k, c])) for k, ((i, _), r) in enumerate(zip(kept, x, strict=True)) for c in range(3))
    own = sorted((-1 if r.vec_id is None else r.vec_id, r.component, int(r.deviation), abs(r.whitened)) for r in got)
    assert [w[:3] for w in own] == [w[:3] for w in wanted]
    assert np.allclose([w[3] for w in own], [w[3] for w in wanted], rtol=1e-8, atol=1e-10)
    assert {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    assert np.allclose(sorted({r.explained for r in got}), sorted(values / np.trace(v)), rtol=1e-9)
    signs = {}
    for r in got:  # one sign of each component for all rows
        if r.vec_id is not None:
            k = [i for i, _ in kept].index(r.vec_id)
            if abs(white[k, r.component - 1]) > 1e-6:
                signs.setdefault(r.component, set()).add(np.sign(r.whitened * white[k, r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whitened(frame([])).count() == 0
    alike = whitening.whitened(frame([(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(alike) == 8 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, 0.0, None, 0) for r in alike)
    line = whitening.whitened(frame([(i, [float(i), 3.0, 2.0 * i]) for i in range(9)])).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in line[:3]] == [False, True, True] and line[0].explained == 1.0 and line[0].identity_error < 1e-12
    mixed = whitening.whitened(frame([(0, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0]), (3, [5.0]), (4, [7.0])])).collect()
    assert {(r.vec_id, r.length, r.n) for r in mixed} == {(0, 2, 3), (1, 2, 3), (2, 2, 3), (3, 1, 2), (4, 1, 2)}
    huge = whitening.whitened(frame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 1e12])])).collect()
    assert len(huge) == 6 and all(r.identity_error < 1e-4 for r in huge)


def test_whitening_query_of_the_given_table(spark):
    got = whitening.op11_whitening(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.stack(rows.embedding.values).astype(float)).astype(int) + 100000
    n, sums = len(x), x.sum(axis=0)
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9
    one = got[got.component == 1].set_index("vec_id").loc[rows.vec_id]
    assert (one.deviation.values == ((n * x - sums) ** 2).sum(axis=1)).all()
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    for c in range(1, 9):
        own = got[got.component == c].set_index("vec_id").loc[rows.vec_id].whitened.values
        white = (x - sums / n) @ vectors[:, -c] / np.sqrt(values[-c])
        assert min(abs(own - white).max(), abs(own + white).max()) < 1e-8


def brute(rows, anchors):
    """Every rule of the operator, row by row."""
    whole = lambda c: int(max(-hard_negatives.FAR, min(hard_negatives.FAR, np.floor(256.0 * c))))
    kept = {(i, lab, tuple(whole(c) for c in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and abs(c) < INF for c in v)}
    out = []
    for i, lab, x in kept:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other, y) for j, other, y in kept if j != i and len(y) == len(x))
        for p, j, _, _ in [s for s in scored if s[2] == lab][:5]:
            inside = [s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, j, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(inside[:3])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, anchors=lambda c: c % 5 == 0):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("mark", F.lit("x")).withColumn("x", F.lit(0))
    return sorted(tuple(r) for r in hard_negatives.mined(frame, F.col("label"), anchors(F.col("vec_id"))).select(*COLUMNS).collect())


@pytest.mark.parametrize("seed, dim, block", [(1, 6, 1 << 16), (2, 7, 40), (3, 1, 25)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, seed, dim, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", block // 2)
    monkeypatch.setattr(hard_negatives, "CENTROIDS", 8)
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(3)) if i % 3 else 0, [float(c) for c in np.round(rng.normal(size=dim), 1)]) for i in range(130)]
    rows += [(200 + i, 1, rows[7][2]) for i in range(20)] + [rows[4], rows[10]]  # copies under other ids, and rows given twice
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 100


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.8, 0.1]), (3, 2, [0.8, 0.3]), (None, 2, [0.7, 0.0]), (5, None, [0.7, 0.0]), (6, 2, None), (7, 2, [NAN, 0.0]), (8, 2, [None, 0.0]), (9, 2, [INF, 0.0])]
    rows += [(10, 3, [1.0]), (11, 3, [1.0]), (12, 4, [0.6]), (15, 5, []), (16, 5, []), (17, 6, []), (20, 7, [1e300, 1.0]), (21, 7, [1e300, 2.0]), (22, 8, [0.7 * 2**18, 1.0]), (0, 2, [0.9, 0.0]), (25, 1, [-1.0, 0.0])]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0)
    assert (0, 1, 1, 3, 65536, 52224) not in got and any(r[0] == 15 for r in got) and any(r[0] == 20 for r in got)
    assert mined(spark, rows[4:10]) == [] and hard_negatives.mined(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.col("label"), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal(size=(3000, 64)) * 32).astype(np.int64)
    books = hard_negatives.Codebooks(x[:1500])
    codes, residual = books.encode(x)
    near, true = books.looked_up(codes, x[:40]), (x @ x[:40].T).astype(float)
    slack = residual[:, None] * np.sqrt((x[:40] ** 2).sum(axis=1))[None, :]
    assert (abs(true - near) <= slack).all()
    assert (near + slack >= np.sort(near - slack, axis=0)[-6]).mean() < 0.2


def test_hard_negatives_query_of_the_given_table(spark):
    got = sorted(tuple(r) for r in hard_negatives.op12_hard_negatives(spark, SF).collect())
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.values, np.floor(256 * np.stack(rows.embedding.values).astype(float)).astype(int)
    label, wanted = np.where(ids % 7 == 0, (rows.label.values + 1) % 10, rows.label.values), []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i]
        for p in [j for j in order if label[j] == label[i]][:5]:
            inside = [j for j in order if label[j] != label[i] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]]
            wanted += [(ids[i], ids[p], rank + 1, ids[j], s[p], s[j]) for rank, j in enumerate(inside[:3])]
    assert got == sorted(wanted) and got
