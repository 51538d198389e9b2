"""Operator 12: whitening of embeddings by a matrix-free block subspace iteration.

Entries become whole levels, each distinct vector of levels counts once (the fit list), and the
leading eigenvectors of the list's covariance V are found without ever forming V. A Spark pass centres
the rows of the list and gives Xᵀ(XQ) for one orthonormal block Q: each task adds up its rows, Spark
adds up the tasks by dimension, and the driver sees one row a dimension. There it orthogonalises (QR)
and solves the Rayleigh-Ritz problem over the span of all blocks since the last restart; the part of
V·Q that is outside that span is the next block, so the span holds every plain subspace iterate and
at most dimension / block passes exhaust the space. The residuals |V u - e u| of all k pairs decide
when it ends. With more than ``BASIS`` columns the iteration starts again from its best vectors.

Levels are centred as integers about the whole part of their mean before anything is multiplied, so
their large common offset costs no digits.

Defined cases: rows whose vector is null or has null or non-finite entries go. The dimension is the
commonest length among the others (of ties the greatest); rows of other lengths lie in another space
and go too, as do empty vectors. Repeated rows and equal vectors are one entry of the fit list and
each gives its rows. Equal eigenvalues: any orthonormal basis of their space, the same for all rows.
Directions without variance (an eigenvalue of at most ``FLAT`` of the greatest) cannot be scaled and
give no component, so there are fewer than k components if the rank is less; with one distinct vector
there are none and the result is empty, as it is for an empty table. Entries beyond 2^48 count as
2^48, with their sign. A deviation that no long holds is null. Further columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, table

#: Fixed values of the contract: steps of a level, its offset, components.
STEPS, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Columns of a block: the components sought and as many guard vectors.
GUARD = 2
#: Columns of the span before a restart; the driver holds two matrices of dimension x this.
BASIS = 2048
#: A residual of this part of the greatest eigenvalue certifies a pair.
TOLERANCE = 1e-13
#: Passes before the iteration gives up with an error.
PASSES = 500
FLAT = 1e-13
#: Rows that are centred and multiplied at once.
ROWS = 8192
LARGEST = float(1 << 48)


def finite(c: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return c.isNotNull() & ~F.coalesce(F.exists(c, bad), F.lit(True))


def levels(c: Column, steps: int = STEPS, offset: int = OFFSET) -> Column:
    """Entries as whole levels."""
    held = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x.cast("double")))
    return F.transform(c, lambda x: F.floor(held(x) * float(steps)) + F.lit(offset).cast("long"))


def dimension(rows: DataFrame) -> int:
    """The commonest length of x; 0 if there is no row."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of lists that all have ``dim`` entries, as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def slices(batches, dim: int, at: int):
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part, matrix(part.column(at), dim)


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], list[int]]:
    """n, and for each dimension the exact sums of x and of (x - OFFSET)²."""

    def run(batches):
        n, total, square = 0, [0] * dim, [0] * dim
        for _, x in slices(batches, dim, 0):
            y = x - OFFSET
            # ROWS rows of less than 2^24 add up to less than 2^61.
            exact = y if np.abs(y).max(initial=0) < 1 << 24 else y.astype(object)
            n += len(y)
            total = [a + int(b) for a, b in zip(total, exact.sum(axis=0), strict=True)]
            square = [a + int(b) for a, b in zip(square, (exact * exact).sum(axis=0), strict=True)]
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(Decimal, total), kind), pa.array(map(Decimal, square), kind)], names=["i", "n", "s", "q"])

    sums = fit.mapInArrow(run, "i int, n long, s decimal(38,0), q decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()
    if not sums:
        return 0, [0] * dim, [0] * dim
    n = sums[0]["n"]
    return n, [int(r["s"]) + n * OFFSET for r in sums], [int(r["q"]) for r in sums]


class Centre:
    """The mean of the fit list as a whole part and a rest, for rows of levels."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum of (n x - S)² a row, exactly."""
        part = np.array([s % self.n for s in self.sums], np.int64 if self.n < 1 << 62 else object)
        y = x - self.whole
        if np.abs(y).max(initial=0) + 1 < (2**62 / max(1, x.shape[1])) ** 0.5 / self.n:
            d = y * self.n - part
            return (d * d).sum(axis=1).tolist()
        d = y.astype(object) * self.n - part.astype(object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def product(fit: DataFrame, centre: Centre, q: np.ndarray, inner: np.ndarray | None = None) -> np.ndarray:
    """One pass: Xᵀ(XQ) / n over the centred rows, a row a dimension. With ``inner`` the rows are
    projected on it first: the covariance of the projections, for q the identity."""
    dim, width = len(centre.sums), q.shape[1]
    base = inner if inner is not None else np.empty((0, 0))

    def run(batches):
        total, seen = np.zeros((q.shape[0], width)), False
        for _, x in slices(batches, dim, 0):
            y = centre.rows(x)
            y = y @ base if base.size else y
            total += y.T @ (y @ q)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "y"])

    tasks = fit.mapInArrow(run, "i int, y array<double>")
    sums = tasks.groupBy("i").agg(F.array(*(F.sum(F.col("y")[j]) for j in range(width))).alias("y")).collect()
    out = np.zeros((q.shape[0], width))
    for r in sums:
        out[r["i"]] = r["y"]
    return out / centre.n


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block has outside the span of ``basis``."""
    q = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    keep = np.ones(q.shape[1], bool)
    for _ in range(2):  # twice is enough
        q = q - basis @ (basis.T @ q)
        q, r = np.linalg.qr(q)
        keep &= np.abs(np.diag(r)) > 1e-12 if _ == 0 else keep
    return q[:, keep]


def subspace(multiply, dim: int, k: int, block: int, basis_most: int = BASIS, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), eigenvectors (columns) of the leading k pairs, and the passes taken.
    ``multiply`` gives V·Q for an orthonormal Q; it is all that is known of V."""
    block = min(dim, block)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    basis, image = np.empty((dim, 0)), np.empty((dim, 0))
    for done in range(1, passes + 1):
        basis, image = np.hstack([basis, q]), np.hstack([image, multiply(q)])
        h = basis.T @ image
        values, inner = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, inner = values[order], inner[:, order]
        top = min(k, len(values))
        vectors = basis @ inner[:, :top]
        residual = image @ inner[:, :top] - vectors * values[:top]
        worst = np.linalg.norm(residual, axis=0).max()
        full = basis.shape[1] >= dim
        if full or worst <= tolerance * max(values[0], 0.0):
            return values[:top], vectors, done
        if basis.shape[1] + block > max(basis_most, 2 * block):  # a restart from the best vectors
            keep = inner[:, :block]
            basis, image = basis @ keep, image @ keep
            wanted = image - basis * values[:block]
        else:
            wanted = image[:, -q.shape[1] :]
        q = orthonormal(wanted, basis)
        missing = min(block, dim - basis.shape[1]) - q.shape[1]
        if missing > 0:  # the block has become dependent: fresh directions fill it
            q = np.hstack([q, orthonormal(rng.standard_normal((dim, missing)), np.hstack([basis, q]))])
    raise RuntimeError(f"{passes} passes left a residual of {worst:.3g} at a greatest eigenvalue of {values[0]:.3g}")


def projected(x: np.ndarray, on: np.ndarray) -> np.ndarray:
    """x @ on, summed in the order of the dimensions, so that equal rows give equal values wherever they
    stand; a matrix product may round a row by its place among the others."""
    out = np.zeros((len(x), on.shape[1]))
    for d in range(on.shape[0]):
        out += x[:, d, None] * on[d]
    return out


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, block: int | None = None) -> DataFrame:
    """One row per row and component: key, component, n, deviation, whitened, explained,
    identity_error, eigenvalue."""
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    spark = rows.sparkSession
    held = rows.select(F.col(key).cast("long").alias(key), F.col(vector).alias("v")).where(finite(F.col("v"))).select(key, levels(F.col("v")).alias("x"))
    dim = dimension(held)
    if not dim:
        return spark.createDataFrame([], schema)
    held = held.where(F.size("x") == dim)
    fit = cut(held.select("x").distinct())
    n, sums, squares = moments(fit, dim)
    centre = Centre(n, sums)
    # V's trace from whole numbers: n·Σ(x - c)² - (Σ(x - c))², over n².
    trace = sum(n * q - (s - n * OFFSET) ** 2 for q, s in zip(squares, sums, strict=True)) / n**2
    if trace <= 0:
        release(fit)
        return spark.createDataFrame([], schema)
    values, vectors, _ = subspace(lambda q: product(fit, centre, q), dim, k, block or GUARD * k)
    top = int((values > FLAT * values[0]).sum())
    values, vectors = values[:top], vectors[:, :top]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(top)])
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(product(fit, centre, np.eye(top), scaled) - np.eye(top)).max())
    release(fit)
    explained = values / trace

    def run(batches):
        for part, x in slices(batches, dim, 1):
            y, m = projected(centre.rows(x), scaled), len(x)
            repeated = np.repeat(np.arange(m), top)
            cols = [
                part.column(0).take(pa.array(repeated)),
                pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), m)),
                pa.array(np.full(m * top, n, np.int64)),
                pa.array(centre.deviations(x), pa.int64()).take(pa.array(repeated)),
                pa.array(y.reshape(-1)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * top, error)),
                pa.array(np.tile(values, m)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return held.mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
