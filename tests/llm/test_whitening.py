"""Whitening against the singular vectors that numpy finds."""

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from trafficlens.llm.whitening import op12_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(vectors):
    """n, deviations, variances and components (as columns) of whole-number vectors, by brute force."""
    fit = np.array(sorted(set(map(tuple, vectors))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(Fraction(int(v), n)) for v in row] for row in fit * n - sums])
    _, sigma, v = np.linalg.svd(centred)
    return n, sums, sigma**2 / n, v.T, (centred**2).sum() / n


def same(rows, vectors, ids, k=4, tolerance=1e-8):
    n, sums, values, columns, trace = expected(vectors)
    got = sorted(rows, key=lambda r: (r.component, r.vec_id))
    want = sorted(zip(ids, vectors, strict=True))
    assert len(got) == k * len(want)
    for c in range(k):
        part = got[c * len(want) : (c + 1) * len(want)]
        z = np.array([[float(Fraction(n * int(x) - int(s), n)) for x, s in zip(v, sums, strict=True)] for _, v in want]) @ columns[:, c] / np.sqrt(values[c])
        found = np.array([r.whitened for r in part])
        assert min(np.abs(found - z).max(), np.abs(found + z).max()) < tolerance, c
        for r, (i, v) in zip(part, want, strict=True):
            assert (r.vec_id, r.component, r.n) == (i, c + 1, n)
            deviation = sum((n * int(x) - int(s)) ** 2 for x, s in zip(v, sums, strict=True))
            assert r.deviation == (deviation if deviation < 1 << 63 else None)
            assert abs(r.explained - values[c] / trace) < 1e-9 and r.identity_error < 1e-8


def test_query(spark):
    for sf in ("sf0.001", "sf0.1"):
        d = f"/root/testdata/{sf}"
        rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
        vectors = [tuple(int(np.floor(256 * np.float64(v))) for v in r.embedding) for r in rows]
        same(op12_whitening(spark, d).collect(), vectors, [r.vec_id for r in rows])


def test_conditions(spark):
    """Variances that span twelve powers of ten, constant and repeated dimensions, copies: less than full rank."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    m = np.floor(rng.standard_normal((400, 6)) * [3e7, 1e6, 4e4, 900, 40, 3] @ basis + 1e5).astype(int)
    m = np.column_stack([m, np.full(400, 7), m[:, 0]])
    m = np.concatenate([m, m[:1].repeat(300, 0)])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "vec_id long, embedding array<double>")
    got = whiten(df, scale=1.0, k=8).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5, 6}
    same(got, list(map(tuple, m)), range(len(m)), 6, 1e-4)


def test_odd_rows(spark):
    rows = [(1, [0.5, 1.0], 1), (2, [0.25, -1.0], 2), (2, [0.25, -1.0], 2), (None, [1.5, 0.0], None), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 0.0], 1), (7, [float("inf"), 0.0], 1), (8, [], 1)]
    rows += [(20, [1.0, 0.0, 3.0], 1), (21, [2.0, 0.0, 3.0], 1)]  # a dimension of their own: one component
    rows += [(30, [1.0] * 4, 1), (31, [1.0] * 4, 1)]  # no variance
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "x": F.lit(1), "dim": F.lit(2), "e": F.lit(0)})
    got = whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (20, 1), (21, 1)]
    two = [r for r in got if r.dim == 2]
    assert {r.n for r in two} == {3} and {r.n for r in got if r.dim == 3} == {2}
    assert {abs(round(r.whitened, 12)) for r in got if r.dim == 3} == {1.0} and {round(r.explained, 12) for r in got if r.dim == 3} == {1.0}
    assert {r.deviation for r in two if r.vec_id is None} == {(3 * 384 - 576) ** 2 + 0**2}
    assert whiten(df.limit(0)).collect() == [] and whiten(df.where("vec_id > 3 and vec_id < 9")).collect() == []


def test_huge_components(spark):
    rows = [(1, [1e300, 1.0]), (2, [1e18, 2.0]), (3, [3.0, 3.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} >= {1}
    assert max(r.identity_error for r in got) < 1e-4 and all(np.isfinite(r.whitened) for r in got)
