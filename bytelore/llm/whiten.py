"""Whitening of embeddings: leading principal components by block subspace iteration, without a covariance matrix.

Each pass over the rows works out Xᵀ(XQ) for a block Q of directions, where X holds the centred rows: a task multiplies its
batches by Q, then by themselves, and gives one matrix of dimension times block; these are added up in a tree.  On the
driver QR makes the block orthonormal and a Rayleigh-Ritz step over the directions tried so far gives approximate
eigenvectors and their residuals.  The residuals' part outside those directions is the next block, until the residuals of
all wanted components, measured in a last pass over the components themselves, are as small as rounding leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a vector's entries before sums are taken: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Directions kept for Rayleigh-Ritz steps, in blocks; with more the best go on alone.
MOST_BLOCKS = 12
#: Greatest residual of a component against the largest eigenvalue, and passes after which the best found is taken.
RESIDUAL, MOST_PASSES = 1e-13, 200
#: Entries of rows that are multiplied at a time.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """Sums of the fitted rows and their leading components; ``residual`` is against the largest eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def valid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is neither null nor holds nulls or entries that are not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _whole(column: pa.Array, dimension: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and whole numbers, without ``SHIFT``, of stretches of a column of vectors."""
    step = max(1, AT_ONCE // max(1, dimension))
    for first in range(0, len(column), step):
        part = column.slice(first, step)
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield first, np.floor(SCALE * flat).reshape(len(part), dimension)


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean without ``SHIFT`` as a whole number and the rest, so that rows are centred without loss."""
    parts = [divmod(s - n * SHIFT, n) for s in sums]
    return np.array([float(a) for a, _ in parts]), np.array([b / n for _, b in parts])


def _sums(rows: DataFrame, dimension: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums of each dimension; a task gives one row, decimals add them up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            for _, x in _whole(batch.column(0), dimension):
                n += len(x)
                # a stretch has 2^20 entries at most, so its sums are exact while entries are below 2^33
                exact = np.abs(x).max(initial=0) < 2**33
                part = x.sum(axis=0) if exact else [sum(map(int, c)) for c in x.T]
                total = [t + int(p) for t, p in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(dimension + 1), pa.int32()), "s": [str(n), *(str(t + n * SHIFT) for t in total)]})

    found = rows.mapInArrow(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return (int(found[0].s), tuple(int(r.s) for r in found[1:])) if found else (0, (0,) * dimension)


def _pass(rows: DataFrame, n: int, sums: tuple[int, ...], q: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Xᵀ(XQ) / n over the centred rows, and each dimension's variance."""
    d, b = q.shape
    whole, rest = _centre(n, sums)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(q)
    groups = max(1, int(tasks**0.5))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        z, squares, seen, block = np.zeros((d, b)), np.zeros(d), False, shared.value
        for batch in batches:
            for _, x in _whole(batch.column(0), d):
                x = (x - whole) - rest
                z += x.T @ (x @ block)
                squares += np.einsum("ij,ij->j", x, x)
                seen = True
        if seen:
            values = np.concatenate([z.ravel(), squares])
            yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % groups], pa.int32()), "m": [values.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, m in zip(batch.column("g").to_pylist(), batch.column("m")):
                values = np.frombuffer(m.as_buffer(), np.float64)
                by_group[g] = by_group[g] + values if g in by_group else values.copy()
        if by_group:
            yield pa.RecordBatch.from_pydict({"g": pa.array(list(by_group), pa.int32()), "m": [v.tobytes() for v in by_group.values()]})

    parts = rows.mapInArrow(multiply, "g int, m binary").repartition(groups, "g").mapInArrow(add, "g int, m binary")
    total = np.zeros(d * b + d)
    for part in sorted(parts.collect(), key=lambda r: r.g):  # at most the root of the number of tasks
        total += np.frombuffer(part.m, np.float64)
    shared.unpersist()
    return total[: d * b].reshape(d, b) / n, total[d * b :] / n


def _outside(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what of ``block`` lies outside ``basis``; without columns where nothing does."""
    scale = np.abs(block).max(initial=0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    keep = np.linalg.norm(block, axis=0) > 1e-14 * max(scale, 1e-300)
    q, r = np.linalg.qr(block[:, keep])
    q = q[:, np.abs(np.diag(r)) > 1e-12 * np.abs(np.diag(r)).max(initial=1e-300)]
    q -= basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 32, block: int | None = None) -> Whitening:
    """Fits over all valid rows of ``vectors``; see ``whitened``."""
    rows = valid(vectors, vector).select(F.col(vector).cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    rows = rows.where(F.size("v") == d)
    tasks = rows.rdd.getNumPartitions() if d else 0
    n, sums = _sums(rows, d) if d else (0, ())
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0)
    if not n or not d:
        return none
    k = min(k, d)
    size = min(d, max(block or 2 * k, k))
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, size)))[0]
    basis, image, passes, trace = np.zeros((d, 0)), np.zeros((d, 0)), 0, 0.0
    while True:
        z, variances = _pass(rows, n, sums, q, tasks)
        passes, trace = passes + 1, float(variances.sum())
        if trace == 0:
            return none
        basis, image = np.hstack([basis, q]), np.hstack([image, z])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, inner = values[order], inner[:, order]
        ritz, mapped = basis @ inner, image @ inner
        off = mapped[:, :k] - ritz[:, :k] * values[:k]
        q = _outside(mapped[:, :size] - ritz[:, :size] * values[:size], basis)
        if np.linalg.norm(off, axis=0).max() <= RESIDUAL * values[0] or not q.shape[1] or passes >= MOST_PASSES:
            break
        if basis.shape[1] + q.shape[1] > MOST_BLOCKS * size:
            basis, image = ritz[:, : 2 * size], mapped[:, : 2 * size]
    # the certifying pass, over the components themselves
    u = np.linalg.qr(ritz[:, :k])[0]
    z, _ = _pass(rows, n, sums, u, tasks)
    small = u.T @ z
    values, inner = np.linalg.eigh((small + small.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > 1e-12 * trace]
    values, u, z = values[order], u @ inner[:, order], z @ inner[:, order]
    flip = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    u, z = u * flip, z * flip
    residual = float(np.linalg.norm(z - u * values, axis=0).max(initial=0) / trace)
    covariance = (u.T @ z) / np.sqrt(np.outer(values, values))
    error = float(np.abs(covariance - np.eye(len(values))).max(initial=0))
    return Whitening(n, sums, u, values, trace, error, residual, passes + 1)


def whitened(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each valid row of ``vectors`` and each component: ``key``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    Entries c become floor(64 c) + 1000000.  ``deviation`` is the exact sum over the dimensions of (n x - S) squared, null
    where a long can't hold it; ``whitened`` is the centred row's projection over the root of the component's eigenvalue;
    ``explained`` is that eigenvalue's share of the total variance.  Rows of another dimension than most have, vectors without entries and
    components without variance (so all, of an empty table, one row, or equal rows) give nothing.  Null and repeated keys stay.
    """
    d, k = model.components.shape
    schema = f"{key} {dict(vectors.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = valid(vectors, vector).where(F.size(vector) == d).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    whole, rest = _centre(model.n, model.sums)
    n, offsets = model.n, [n_sum - model.n * SHIFT for n_sum in model.sums]
    project = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace
    shared = vectors.sparkSession.sparkContext.broadcast(project)
    error = model.identity_error

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = np.array(offsets, object)
        for batch in batches:
            for first, x in _whole(batch.column("v"), d):
                y = ((x - whole) - rest) @ shared.value
                top = float(np.abs(x - whole).max(initial=0) + 1) * n
                if top * top * d < 2**62 and max(map(abs, offsets)) < 2**62:
                    deviation = ((n * x.astype(np.int64) - np.array(offsets, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    exact = ((n * np.frompyfunc(int, 1, 1)(x) - fixed) ** 2).sum(axis=1)
                    deviation = [s if s < 2**63 else None for s in exact]
                m = len(x)
                keys = batch.column("key").slice(first, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(transform, schema)
