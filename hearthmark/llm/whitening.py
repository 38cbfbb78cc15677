"""Embedding whitening by spectrum slicing: LDL^T inertia counts, Rayleigh quotient iteration, certified numbering.

Entries become whole numbers, so sums and deviations are exact. The covariance is summed in Spark, centred before multiplying;
what reaches the driver is a sum for each dimension and a cell for each pair of dimensions, whatever the number of vectors. There
the number of eigenvalues above a shift is read from the signs of an LDL^T factorisation of the shifted covariance. Bisection by such
counts isolates the k-th largest eigenvalue, Rayleigh quotient iteration converges to it, and counts on both sides of what
it found certify that it is the k-th.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import common_width, matrix, stored

SCALE, COMPONENTS = 256, 4
EPS = float(np.finfo(float).eps)
ALPHA = (1 + 17**0.5) / 8  # the pivot bound of Bunch and Kaufman


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, negative and zero eigenvalues of a symmetric matrix, from its pivoted LDL^T factors."""
    a, n, i, signs = a.copy(), len(a), 0, []

    def swap(p: int, q: int) -> None:
        a[[p, q]] = a[[q, p]]
        a[:, [p, q]] = a[:, [q, p]]

    while i < n:
        below = np.abs(a[i + 1 :, i])
        most = float(below.max(initial=0.0))
        size = 1
        if abs(a[i, i]) < ALPHA * most:
            r = i + 1 + int(below.argmax())
            other = np.abs(a[i:, r])
            other[r - i] = 0
            if abs(a[i, i]) * other.max() >= ALPHA * most**2:
                pass
            elif abs(a[r, r]) >= ALPHA * other.max():
                swap(i, r)
            else:
                swap(i + 1, r)
                size = 2
        if size == 1:
            d = a[i, i]
            signs.append(np.sign(d))
            if d:
                a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i] / d, a[i + 1 :, i])
        else:
            block, rest = a[i : i + 2, i : i + 2], a[i + 2 :, i : i + 2]
            signs += [1, -1] if np.linalg.det(block) < 0 else [np.sign(np.trace(block))] * 2
            a[i + 2 :, i + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        i += size
    return signs.count(1), signs.count(-1), signs.count(0)


class Spectrum:
    """The leading eigenpairs of a symmetric matrix, one after the other."""

    def __init__(self, v: np.ndarray):
        self.v, self.d = v, len(v)
        self.norm = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue lies beyond it
        self.values: list[float] = []
        self.vectors = np.zeros((0, self.d))
        self._known: dict[float, int] = {}

    def above(self, shift: float) -> int:
        """How many eigenvalues lie above the shift."""
        if shift not in self._known:
            self._known[shift] = inertia(self.v - shift * np.eye(self.d))[0]
        return self._known[shift]

    def _unit(self, y: np.ndarray) -> np.ndarray:
        for _ in range(2):  # twice is enough to be orthogonal to working precision
            y = y - self.vectors.T @ (self.vectors @ y)
            y = y / np.linalg.norm(y)
        return y

    def _solve(self, shift: float, y: np.ndarray) -> np.ndarray:
        for off in (0, 4, 9, 19):  # a shift may be an eigenvalue to the last bit
            try:
                z = np.linalg.solve(self.v - (shift + off * EPS * self.norm) * np.eye(self.d), y)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(z).all() and z.any():
                return z
        return y

    def _iterate(self, low: float, high: float) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration from inverse iterations at the middle; None if it leaves the interval."""
        y = self._unit(np.random.default_rng(17).standard_normal(self.d))
        middle, tight = (low + high) / 2, high - low <= 16 * EPS * self.norm
        for _ in range(3):
            y = self._unit(self._solve(middle, y))
        for _ in range(30):
            value = float(y @ self.v @ y)
            if not tight and not low <= value <= high:
                return None
            if np.linalg.norm(self.v @ y - value * y) <= 8 * EPS * self.norm:
                return value, y
            y = self._unit(self._solve(middle if tight else value, y))
        return (float(y @ self.v @ y), y) if tight else None

    def find(self, k: int) -> tuple[float, np.ndarray]:
        """The k-th largest eigenvalue, counted from 1, and a unit eigenvector orthogonal to those found before.

        Equal eigenvalues, which no interval separates, get an orthonormal set of eigenvectors.
        """
        low, high = -1.01 * self.norm, 1.01 * self.norm
        slack = 32 * EPS * self.norm
        found = (0.0, self._unit(np.random.default_rng(17).standard_normal(self.d))) if not self.norm else None
        while not found:
            apart = self.above(low) == k and self.above(high) == k - 1
            tight = high - low <= 16 * EPS * self.norm
            if apart or tight:
                found = self._iterate(low, high)
                if found and self.above(found[0] - slack) >= k > self.above(found[0] + slack):  # certified
                    break
                found = None
                if tight:
                    raise ArithmeticError(f"eigenvalue {k} could not be certified")
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        value, y = found
        y = y * (1 if y[np.abs(y).argmax()] > 0 else -1)
        self.values.append(value)
        self.vectors = np.vstack([self.vectors, y])
        return value, y


@dataclass
class Whitening:
    """n fitted vectors with their sums by dimension, components (one a row) with eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.components.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n*x-S)^2, exactly; None where it is beyond a long."""
        span = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        small = span * span * max(1, x.shape[1]) < 2**63
        gap = self.n * x.astype(np.int64 if small else object) - np.array(self.sums, np.int64 if small else object)
        return [s if s < 2**63 else None for s in (gap * gap).sum(axis=1).tolist()]


def whole(vector: Column) -> Column:
    """floor(256*c) of every entry as long; null where the vector is null or holds null or non-finite entries."""
    value = vector.cast("array<double>")
    fine = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(value, lambda c: F.floor(c * SCALE).cast("long")))


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            x = matrix(batch.column("x"), width)
            x = x if np.abs(x).max(initial=0) < 2**44 else x.astype(object)
            total, n = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)], n + len(x)
        rows = [pa.array(range(width), pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, ["i", "s", "n"])

    return run


def _products(mean: np.ndarray):
    i, j = np.triu_indices(len(mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            y = matrix(batch.column("x"), len(mean)) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "p"])

    return run


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of whole-number vectors x, each distinct one once; None without rows.

    Components end where the covariance has no more variance, so that there are fewer than k for fewer dimensions or vectors.
    """
    width = common_width(vectors, "x")
    if not width:
        return None
    once = stored(vectors.filter(F.size("x") == width).select("x").distinct(), "fit")
    by_dim = once.mapInArrow(_sums(width), "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, sums = by_dim[0]["n"], [int(r["s"]) for r in by_dim]
    cells = once.mapInArrow(_products(np.array([s / n for s in sums])), "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    v = np.zeros((width, width))
    for r in cells:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["p"] / n
    spectrum = Spectrum(v)
    for c in range(1, min(k, width) + 1):
        if spectrum.above(width * 8 * EPS * spectrum.norm) < c:
            break
        spectrum.find(c)
    model = Whitening(n, sums, spectrum.vectors, np.array(spectrum.values), float(np.trace(v)))
    if spectrum.values:
        pairs = [(a, b) for a in range(len(model.values)) for b in range(a + 1)]
        spread = project(once.select(F.lit(None).cast("long").alias("id"), "x"), model).agg(*(F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
        model.identity_error = max(abs(spread[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    return model


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, w) of rows (id, x): the exact squared deviation and the whitened coordinates."""
    width, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            w = pa.FixedSizeListArray.from_arrays(pa.array(model.project(x).ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.deviations(x), pa.int64()), w], ["id", "deviation", "w"])

    return rows.mapInArrow(run, "id long, deviation long, w array<double>")


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Left out are rows whose vector is null, empty, holds null or non-finite entries, or has another width than the most
    common one (of equally common ones the smallest). Repeated rows stay, and count once in the fit; a null id stays. A table whose
    vectors are all equal has no component and gives no rows. A deviation beyond a long is null.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vec_col)).alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0))
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, k)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], out)
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    made = project(rows.filter(F.size("x") == len(model.sums)), model).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return made.select(F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable vector on the four leading components of the distinct vectors' covariance."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
