"""Operator 12: embedding whitening by shifted CholeskyQR.

The centred rows are made orthonormal step by step: a distributed pass sums the Gram matrix of the rows after the triangular
solves so far, its Cholesky factor is the next triangular factor, and the factors' product is R of the rows' QR
factorisation.  The first step shifts the Gram matrix, so that rows of any condition, or of less than full rank, have a
factor.  The singular vectors of R are the components.  Only matrices of the vectors' dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Steps of orthogonalisation at most, and how far the last Gram matrix may be from a projection.
STEPS, RESIDUAL = 6, 1e-9
#: Components whose standard deviation is below this part of the largest, or of the vectors' dimension in rounding errors of
#: the largest value, are rounding, not variance.
RANK = 1e-10
#: Rows of a block: what a task multiplies at once.
BLOCK_ROWS = 4096
#: Integers below this are exact as doubles and don't overflow when two are added.
SAFE = 1 << 62
UNIT = np.finfo(float).eps / 2


def scaled(df: DataFrame, vec_col: str, scale: float) -> DataFrame:
    """df with a column x: floor(scale * component) as longs (saturated there), without the rows whose vector is null, is
    empty, or holds null or non-finite components."""
    e = F.col(vec_col).cast("array<double>")
    sound = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    return df.where(sound).withColumn("x", F.transform(e, lambda v: F.floor(v * F.lit(scale))))


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch in blocks, with the position of each block's first row."""
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.column("x").slice(at, BLOCK_ROWS)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)


@dataclass(frozen=True)
class Centre:
    """n rows and their exact sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they suffice, else Python's integers."""
        if int(np.abs(x).astype(float).max(initial=0)) * self.n + max(map(abs, self.sums)) < SAFE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n."""
        whole = self.of(x)
        if whole.dtype == object:
            return np.array([[float(Fraction(v, self.n)) for v in row] for row in whole])
        return whole.astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n * x - sums; null if it is more than a long holds."""
        whole = self.of(x)
        if whole.dtype == object or float(np.abs(whole).max(initial=0)) ** 2 * whole.shape[1] >= SAFE:
            whole = whole.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (whole * whole).sum(1)]


def _summed(fit: DataFrame, dim: int, columns: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over fit of a matrix that `values` makes of each block of rows: tasks add up their blocks, then the matrices'
    rows are added up by number, so what a task or the driver holds doesn't grow with the rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(values(x) for batch in batches for _, x in _blocks(batch, dim))
        if not isinstance(total, int):  # a task may have no rows
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.select("x").mapInArrow(part, "i int, row array<double>")
    rows = parts.groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(columns))).alias("row")).collect()
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def _solve(factors: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """rows times the inverses of the upper triangular factors, first to last."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper triangular Cholesky factor of a Gram matrix of n rows, shifted if asked for or needed."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * UNIT * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + (shift if shifted else 0.0) * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift, shifted = shift * (10 if shifted else 1), True


@dataclass(frozen=True)
class Whitener:
    """What whitening one dimension takes: the centre, the components as columns, their variances and the whole variance."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.variances)


def centre_of(fit: DataFrame, dim: int) -> Centre:
    """Count and exact sums of the rows' x: by task, then by position."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            for _, x in _blocks(batch, dim):
                small = float(np.abs(x.astype(float)).max()) * len(x) < SAFE
                n, sums = n + len(x), [a + int(b) for a, b in zip(sums, (x if small else x.astype(object)).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], names=["i", "n", "s"])

    parts = fit.select("x").mapInArrow(part, "i int, n long, s decimal(38,0)")
    rows = {r.i: r for r in parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    return Centre(rows[0].n, tuple(int(rows[i].s) for i in range(dim)))


def fit_whitener(fit: DataFrame, dim: int, k: int | None = None) -> Whitener | None:
    """fit: rows of distinct x of one dimension.  The k leading components (all that have variance, if fewer), as columns
    whose largest entry is positive; None where no component has any."""
    centre = centre_of(fit, dim)
    factors: list[np.ndarray] = []
    trace = 0.0
    while True:
        done = list(factors)
        gram = _summed(fit, dim, dim, lambda x, done=done: (lambda q: q.T @ q)(_solve(done, centre.centred(x))))
        if not factors:
            trace = float(np.trace(gram)) / centre.n
            if trace == 0:
                return None
        elif len(factors) == STEPS or np.abs(gram @ gram - gram).max() < RESIDUAL:
            break
        factors.append(_factor(gram, centre.n, shifted=not factors))
    # The last Gram matrix, a projection to rounding, closes the product: it takes out what the shifts put in.
    values, vectors = np.linalg.eigh(gram)
    r = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for factor in reversed(factors):
        r = r @ factor
    _, sigma, v = np.linalg.svd(r)
    largest = max(map(abs, centre.sums)) / centre.n
    sound = sigma > max(RANK * sigma[0], dim * UNIT * largest * np.sqrt(centre.n))
    keep = np.flatnonzero(sound)[:k]
    columns = v[keep].T
    columns = columns * np.where(columns[np.abs(columns).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    return Whitener(centre, columns, sigma[keep] ** 2 / centre.n, trace) if len(keep) else None


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """The largest absolute entry of the covariance of fit's whitened rows, minus the identity; their means are taken off
    before multiplying."""
    dim, k = w.components.shape
    mean = _summed(fit, dim, k, lambda x: w.whiten(x).sum(0, keepdims=True))[0] / w.centre.n
    cov = _summed(fit, dim, k, lambda x: (lambda z: z.T @ z)(w.whiten(x) - mean)) / w.centre.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, k: int = 4) -> DataFrame:
    """One row per vector and component (1 to k by falling variance): vec_id, component, n, deviation, whitened, explained,
    identity_error, and the row's dimension dim.

    Rows whose vector is null, empty, or holds null or non-finite components are left out; null and repeated ids stay and
    are rows like others.  Copies count once in the fit.  Vectors of unlike dimensions have nothing in common, so each
    dimension is fitted by itself, with its own n.  Components without variance (all vectors equal, or fewer than k
    dimensions that vary) have no rows.  Ties of variances are in the order that the decomposition gives, the same for all
    rows.  `deviation` is null where it is more than a long holds; components of over 2**63 / scale count as that.  Other
    columns are not read, whatever their names; an empty table gives an empty result.

    Copies are gathered by partial aggregation, so a common vector is one row per task before the shuffle.  The fitted
    matrices (dimension squared) go to the driver, and the components (dimension times k) to the tasks, never rows.
    """
    spark = vectors.sparkSession
    rows = materialise(scaled(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")), "e", scale).select("vec_id", "x", F.size("x").alias("dim")))
    fit = materialise(rows.select("dim", "x").distinct())
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, dim int"
    result, names = spark.createDataFrame([], out), [c.split()[0] for c in out.split(", ")]
    for dim in sorted(r.dim for r in fit.select("dim").distinct().collect()):
        own = fit.where(F.col("dim") == dim)
        w = fit_whitener(own, dim, k)
        if w is None:
            continue
        error = identity_error(own, w)

        def run(batches: Iterator[pa.RecordBatch], w: Whitener = w, error: float = error, dim: int = dim) -> Iterator[pa.RecordBatch]:
            m = len(w.variances)
            for batch in batches:
                for at, x in _blocks(batch, dim):
                    each = np.repeat(np.arange(len(x)), m)
                    ids, deviation = batch.column("vec_id").slice(at, len(x)), pa.array(w.centre.deviation(x), pa.int64())
                    component, explained = np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), np.tile(w.variances / w.trace, len(x))
                    same = [np.full(len(each), v, t) for v, t in ((w.centre.n, np.int64), (error, float), (dim, np.int32))]
                    columns = [ids.take(pa.array(each)), component, same[0], deviation.take(pa.array(each)), w.whiten(x).ravel(), explained, same[1], same[2]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        result = result.union(rows.where(F.col("dim") == dim).select("vec_id", "x").mapInArrow(run, out))
    return result


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).drop("dim")
