"""13. Embedding whitening: principal components of unit variance, from an exact integer scatter.

Entries become integers x = floor(64 * c) + 1,000,000.  The fit list is each distinct vector
once.  Every task subtracts a shift, which no covariance depends on, and adds up the shifted
vectors and their cross-products in arbitrary precision; it sends them as 32-bit limbs, which
Spark sums as 64-bit integers, so the result is the same in any order and nothing is rounded.
The driver, which gets a number of limbs that depends on the dimension alone, forms
n * XtX - S * St exactly, only then divides into doubles, and decomposes by eigh.

Cross-products use double matrix products where they are exact: entries are cut into limbs of
20 bits, and rows into blocks of 8,192, so that no sum reaches 2^53.

Dropped: vectors that are null or hold a null, a NaN or an infinity, and vectors of another
length than most have (of equally frequent lengths the longest stays).  64 * c is held within
+-2^61.  `deviation` is null where it does not fit into 64 bits.  A component whose variance
is 0 within rounding has a null `whitened` and is left out of identity_error; so with one
distinct vector all are null.  Repeated rows and ids give a row each; ids may be null.  An
empty table, or one without a remaining row, gives an empty result.  Further columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut

LIMB = 20
BLOCK = 1 << 13
SHIFT = 1_000_000


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of d long entries a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles of LIMB bits whose weighted sum is x; the last one has the sign."""
    out = []
    while len(x) and int(max(x.max(), -x.min())) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows of an integer matrix, as arrays of Python integers."""
    d = x.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(x), BLOCK):
        parts = _limbs(x[at : at + BLOCK])
        for i, a in enumerate(parts):
            sums += a.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
            for j, b in enumerate(parts):
                products += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return sums, products


def _to_limbs(i: int, j: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, k, limb) with value = sum of limb * 2^32k; the last limb has the sign."""
    k = 0
    while not -(1 << 31) <= value < 1 << 31:
        yield i, j, k, value & 0xFFFFFFFF
        value >>= 32
        k += 1
    yield i, j, k, value


class Fit(NamedTuple):
    n: int
    sums: list[int]  # of the shifted entries
    covariance: np.ndarray
    values: np.ndarray  # falling
    vectors: np.ndarray  # unit columns
    trace: float


def fit(vectors: DataFrame, d: int) -> Fit:
    """Exact scatter of `vectors` (x: array of long), then its decomposition; one row of limbs for each entry comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = _matrix(batch.column(0), d) - SHIFT
            s, p = scatter(x)
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            rows = [*_to_limbs(-1, -1, n), *(r for i in range(d) for r in _to_limbs(i, -1, sums[i])), *(r for i in range(d) for j in range(i, d) for r in _to_limbs(i, j, products[i, j]))]
            i, j, k, v = map(list, zip(*rows))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.int64())], names=["i", "j", "k", "v"])

    limbs = vectors.mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).toArrow()
    exact: dict[tuple[int, int], int] = {}
    for i, j, k, v in zip(*(c.to_pylist() for c in limbs.columns)):
        exact[i, j] = exact.get((i, j), 0) + (v << (32 * k))
    n, sums = exact[-1, -1], [exact[i, -1] for i in range(d)]
    # Python divides whole numbers of any size into the nearest double.
    covariance = np.array([[(n * exact[min(i, j), max(i, j)] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    heads = vectors_[np.abs(vectors_).argmax(axis=0), np.arange(d)]
    return Fit(n, sums, covariance, values, vectors_ * np.where(heads < 0, -1.0, 1.0), float(np.trace(covariance)))


class Whitener:
    """Rows onto components: what each task needs of a fit; its size depends on the dimension alone."""

    def __init__(self, f: Fit, components: int) -> None:
        self.k = min(components, len(f.values))
        self.n, self.sums, self.d = f.n, f.sums, len(f.sums)
        self.mean = np.array([s / f.n for s in f.sums])
        self.used = f.values[: self.k] > max(f.trace, 0.0) * self.d * 1e-14
        scale = np.where(self.used, np.sqrt(np.where(self.used, f.values[: self.k], 1.0)), np.nan)
        self.onto = f.vectors[:, : self.k] / scale
        self.explained = f.values[: self.k] / f.trace if f.trace > 0 else np.full(self.k, np.nan)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.onto

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum of (n * x - S)^2 by row, exactly; the shift cancels out."""
        most = self.n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, self.sums)) if x.size else 0
        if most * most * self.d < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def identity_error(vectors: DataFrame, w: Whitener) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list) - identity.

    Every batch is centred by its own mean before its rows are multiplied; from sums over the batches of
    their sizes, means, products of means and scatters follows the scatter of all about the mean of all.
    """
    used = np.flatnonzero(w.used)
    if not len(used):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(used)
        n, sums, means, within = 0, np.zeros(k), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                y = w.whiten(_matrix(batch.column(0), w.d) - SHIFT)[:, used]
                m = y.mean(axis=0)
                n, sums = n + len(y), sums + len(y) * m
                means, within = means + len(y) * np.outer(m, m), within + (y - m).T @ (y - m)
        if n:
            i, j = (a.ravel() for a in np.indices((k, k)))
            flat = [pa.array(i), pa.array(j), pa.array(np.full(k * k, float(n))), pa.array(sums[i]), pa.array((means + within).ravel())]
            yield pa.record_batch(flat, names=["i", "j", "n", "s", "v"])

    rows = vectors.mapInArrow(run, "i long, j long, n double, s double, v double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in "nsv")).collect()
    mean = {r["i"]: r["s"] / r["n"] for r in rows}
    return max(abs(r["v"] / r["n"] - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    fine = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & fine)
    widest = rows.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if widest is None:
        return spark.createDataFrame([], OUT)
    d, limit = widest["d"], float(1 << 61)
    held = lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), 64 * c))
    rows = rows.where(F.size("c") == d).select("vec_id", F.transform("c", lambda c: F.floor(held(c)) + SHIFT).alias("x"))

    distinct = cut(rows.select("x").distinct())
    f = fit(distinct, d)
    w = Whitener(f, components)
    error = identity_error(distinct, w)
    shared, n = spark.sparkContext.broadcast(w), f.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = w.k
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, m = _matrix(batch.column(1), w.d) - SHIFT, batch.num_rows
                spread = pa.array(np.repeat(np.arange(m), k))
                white = w.whiten(x).ravel()
                yield pa.record_batch(
                    [
                        batch.column(0).take(spread),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array(w.deviation(x), pa.int64()).take(spread),
                        pa.array(white, pa.float64(), mask=np.isnan(white)),
                        pa.array(np.tile(w.explained, m), pa.float64(), mask=np.tile(np.isnan(w.explained), m)),
                        pa.array(np.full(m * k, np.nan if error is None else error), pa.float64(), mask=np.full(m * k, error is None)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, OUT)
