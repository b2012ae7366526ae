"""Embedding whitening: the leading eigenvectors of the covariance by matrix-free block Lanczos passes.

Entries become integers, so that means and deviations are exact. The covariance is never formed: each pass over the distinct
vectors multiplies a block of directions by the centred XᵀX / n, partitions add up their shares, and the driver holds only
dim x basis numbers. The trace is the sum of squared deviations, which gives shares of variance without the other eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, prepare

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries must be below this in absolute value, so that SCALE times it is an exact integer in a double.
MOST = 2.0**47
#: Residuals and eigenvalues below these shares of the largest eigenvalue are noise.
TOLERANCE, ZERO = 1e-13, 1e-12
#: Tasks that add up what partitions send, before the driver does.
ADDERS = 16


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dim: int, count: int, block: int = 0, most: int = 0, seed: int = 7, passes: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues (falling) and unit eigenvectors, as columns, of a symmetric operator of size dim.

    apply multiplies a dim x b block; blocks are at least count wide, so that equal eigenvalues are all found. Every new block is made orthogonal to the whole basis, twice; directions that vanish
    by that (a breakdown) start again at random. The basis is cut to the best Ritz vectors once it has `most` columns.
    It ends when residuals are below TOLERANCE of the largest eigenvalue, or when the basis is the whole space.
    """
    random = np.random.default_rng(seed)
    block, most = min(dim, max(block or count + 4, count)), min(dim, most or max(8 * count, 128))
    if most < dim:
        most = max(most, count + 2 * block)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))

    def fresh(found: np.ndarray, width: int) -> np.ndarray:
        """Up to width orthonormal columns that span found and are orthogonal to the basis, filled up at random."""
        out, columns = np.zeros((dim, 0)), list(found.T)
        while out.shape[1] < width:
            was = columns.pop(0) if columns else random.standard_normal(dim)
            size, x = np.linalg.norm(was), was
            for _ in range(2):
                x = x - basis @ (basis.T @ x)
                x = x - out @ (out.T @ x)
            if size > 0 and np.linalg.norm(x) > 1e-10 * size:
                x = x / np.linalg.norm(x)
                x = x - basis @ (basis.T @ x) - out @ (out.T @ x)
                out = np.column_stack([out, x / np.linalg.norm(x)])
        return out

    x = fresh(np.zeros((dim, 0)), block)
    for _ in range(passes):
        y = apply(x)
        basis, image = np.column_stack([basis, x]), np.column_stack([image, y])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        k = min(count, len(values))
        vectors = basis @ turn[:, :k]
        residual = np.linalg.norm(image @ turn[:, :k] - vectors * values[:k], axis=0)
        if basis.shape[1] == dim or k == count and (residual <= TOLERANCE * max(values[0], 0)).all():
            return values[:k], vectors / np.linalg.norm(vectors, axis=0)
        x = fresh(y, min(block, dim - basis.shape[1]))
        if basis.shape[1] + x.shape[1] > most:
            kept = turn[:, : count + block]
            basis, image = basis @ kept, image @ kept
    raise ArithmeticError(f"residuals {residual} after {passes} passes")


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n distinct integer vectors with these sums, its components with their eigenvalues, and the largest
    absolute entry of the covariance of the whitened distinct vectors less the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, as 64-bit integers if they hold it, else as Python's."""
        if x.size and self.n * (int(np.abs(x).max()) + 1) + max(map(abs, self.sums)) >= 1 << 62:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, rounded once."""
        return (self.exact(x) / self.n).astype(np.float64)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - sums; None where a 64-bit integer can't hold one."""
        exact = self.exact(x)
        if exact.dtype != object and exact.size and int(np.abs(exact).max()) ** 2 * self.dim < 1 << 63:
            return (exact * exact).sum(axis=1).tolist()
        found = (exact.astype(object) ** 2).sum(axis=1).tolist() if exact.size else []
        return [v if v < 1 << 63 else None for v in found]


def integers(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) of the rows of a list column without null or non-finite entries, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths) if dim is None else [dim]:
        rows = np.flatnonzero(lengths == n)
        if n and len(rows):
            flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
            entries = flat.to_numpy(zero_copy_only=False).reshape(len(rows), n)  # null entries are NaN
            good = (np.abs(entries) < MOST).all(axis=1)
            yield rows[good], np.floor(SCALE * entries[good]).astype(np.int64) + SHIFT


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in integers(batch["vector"]):
            narrow = np.abs(x).max(axis=1) < 1 << 31  # so that equal vectors are equal bytes, and most take 4 bytes an entry
            packed = [row.astype("<i4" if few else "<i8").tobytes() for row, few in zip(x, narrow, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(packed, pa.binary())], ["dim", "x"])


def _unpacked(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(x, "<i4" if len(x) == 4 * dim else "<i8") for x in batch["x"].to_pylist()], np.int64).reshape(-1, dim)


def _summed(fit: DataFrame, shape: tuple[int, int], share: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """The sum over all vectors of fit of what share makes of a batch: by partition, by adder, then on the driver."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += share(_unpacked(batch, dim))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in batch["part"]:
                total += np.frombuffer(part.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    rows = fit.select("x").mapInArrow(parts, "part binary").repartition(ADDERS).mapInArrow(added, "part binary").collect()
    return sum((np.frombuffer(r.part).reshape(shape) for r in rows), np.zeros(shape))


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(dim, object)
    for batch in batches:
        x = _unpacked(batch, dim)
        n += len(x)
        total = total + (x.sum(axis=0).astype(object) if not x.size or int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([Decimal(int(v)) for v in [*total, n]], pa.decimal128(38, 0))], ["i", "v"])


def _identity_error(table: DataFrame, model: Whitening) -> float:
    k = len(model.values)

    def share(x: np.ndarray) -> np.ndarray:
        z = model.project(x)
        return np.vstack([z.T @ z, z.sum(axis=0, keepdims=True)])

    total = _summed(table, (k + 1, k), share, model.dim) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = 16, vector_col: str = "embedding") -> Whitening | None:
    """Learn a whitening from each distinct integer vector once; None if none is left or all are equal.

    Vectors that are null, empty, or hold null, non-finite or absurdly large entries (MOST) are left out. If lengths differ, the most
    frequent one counts (of equally frequent ones the largest). Directions without variance are no components.
    """
    prepare(rows.sparkSession)
    vectors = rows.select(F.col(vector_col).alias("vector")).mapInArrow(_distinct, "dim int, x binary").distinct()
    table = materialize(vectors, "whitening")
    lengths = table.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0].dim
    table = table.where(F.col("dim") == dim)
    totals = {r.i: int(r.v) for r in table.select("x").mapInArrow(lambda b: _sums(b, dim), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    start = Whitening(totals.pop(dim), [totals[i] for i in range(dim)], np.zeros(0), np.zeros((dim, 0)), 0.0)
    trace = 0.0

    def apply(x: np.ndarray) -> np.ndarray:
        nonlocal trace

        def share(rows: np.ndarray) -> np.ndarray:
            centred = start.centred(rows)
            return np.vstack([centred.T @ (centred @ x), np.full((1, x.shape[1]), (centred * centred).sum())])

        total = _summed(table, (dim + 1, x.shape[1]), share, dim) / start.n
        trace = float(total[dim, 0])
        return total[:dim]

    values, vectors = lanczos(apply, dim, components)
    some = (values > ZERO * max(values[0], 0)) & (values > 0)
    if not some.any():
        return None
    found = replace(start, values=values[some], vectors=vectors[:, some], trace=trace)
    return replace(found, identity_error=_identity_error(table, found))


def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each remaining row and component one.

    Rows whose vector is null, empty, of another length than the most frequent one, or holds null, non-finite or absurdly large
    entries (2**47 and more) are left out. Repeated rows and rows with a null id stay. deviation is null where a 64-bit integer can't
    hold it. There are at most `components`, as many as have variance: with one distinct vector or an empty table the result is empty.
    Other columns of rows are not read.
    """
    spark = rows.sparkSession
    prepare(spark)
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = named.schema["id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(named, components, "vector")
    if model is None:
        return spark.createDataFrame([], schema)
    shares = np.minimum(model.values / model.trace, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for at, x in integers(batch["vector"], model.dim):
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.project(x).ravel()),
                        pa.array(np.tile(shares, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return named.mapInArrow(run, schema)
