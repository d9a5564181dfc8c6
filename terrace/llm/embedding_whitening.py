"""Whitening of embeddings by principal components found with spectral divide and conquer.

1. A first pass sums the integer vectors x = floor(64 * c) + 1000000, exactly.
2. A second pass sums products of the centred vectors, a matrix a task, added up by cell.
3. The driver, which holds one matrix of dimension by dimension and no rows, splits it: the
   polar factor U of V - sI, by the QR form of Halley's iteration with dynamic weights, has
   the eigenvalue 1 where V's lies above the shift s and -1 below, so (U + I) / 2 projects
   on the upper invariant subspace.  Bases of both subspaces carry V to two smaller
   matrices, which are split in turn until one dimension is left.  Newton-like steps then
   take the vectors from the splitting's accuracy to that of double precision.
4. The components, at most ``COMPONENTS`` by dimension, go with the tasks of a third pass.
   The covariance of its written result is measured in two more passes.

Defined cases: rows whose vector is null or holds null or non-finite entries go, as do rows
of another length than the commonest one (of equally common ones the longest) and empty
vectors; entries beyond 2^53 / 64 in magnitude are held there; repeated rows count as often
as they come; components whose eigenvalue is not above rounding (few or repeated vectors)
have no direction and are left out, as are those beyond the dimension; a deviation beyond
the range of long is null; of equal eigenvalues any basis serves; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: A larger matrix than this does not go through the driver.
MOST_DIMENSIONS = 4096
#: Rows that a task multiplies at once.
ROWS = 4096
_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps in QR form."""
    n = len(a)
    eye, x, low = np.eye(n), a / np.linalg.norm(a), _EPS / n
    for _ in range(60):
        ratio = low * low
        gamma = np.cbrt(4 * (1 - ratio) / (ratio * ratio))
        root = np.sqrt(1 + gamma)
        wa = root + 0.5 * np.sqrt(8 - 4 * gamma + 8 * (2 - ratio) / (ratio * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * ratio) / (1 + wc * ratio))
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.sqrt(n) * 8 * _EPS or (abs(low - 1) < 8 * _EPS and moved < np.cbrt(_EPS)):
            break
    return x


def _split(a: np.ndarray, shift: float, seed: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the invariant subspaces above and below the shift, and how far the matrix couples them; None if all lies on one side."""
    n = len(a)
    p = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(p)))
    if not 0 < k < n:
        return None
    q = np.linalg.qr(p @ np.random.default_rng(seed).standard_normal((n, k)))[0]
    q = np.linalg.qr(p @ q, mode="complete")[0]
    upper, lower = q[:, :k], q[:, k:]
    return upper, lower, float(np.linalg.norm(upper.T @ a @ lower))


def eigenvectors(a: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of a symmetric matrix as columns, in no order."""
    scale = np.linalg.norm(a)
    todo, found = [(np.eye(len(a)), a)], []
    while todo:
        basis, part = todo.pop()
        n = len(part)
        spread = np.linalg.norm(part - np.eye(n) * np.trace(part) / n)
        if n == 1 or spread <= n * _EPS * scale:
            found.append(basis)
            continue
        best = None
        middle = np.trace(part) / n
        for seed, shift in enumerate([np.median(np.diag(part)), middle, *(middle + spread / np.sqrt(n) * f for f in (0.1, -0.1, 0.37, -0.37, 0.73, -0.73))]):
            split = _split(part, shift, seed)
            if split and (best is None or split[2] < best[2]):
                best = split
            if best and best[2] <= 50 * n * _EPS * scale:
                break
        if best is None:
            found.append(basis)
            continue
        for side in best[:2]:
            small = side.T @ part @ side
            todo.append((basis @ side, (small + small.T) / 2))
    return np.hstack(found)


def refine(a: np.ndarray, x: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors after Newton-like corrections of all vectors at once."""
    n = len(a)
    for _ in range(steps):
        r, s = np.eye(n) - x.T @ x, x.T @ a @ x
        value = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.linalg.norm(s - np.diag(value)) + np.linalg.norm(a) * np.linalg.norm(r))
        gap = value[None, :] - value[:, None]
        far = np.abs(gap) > max(near, n * _EPS * np.linalg.norm(a))
        e = np.where(far, (s + value[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        x = x @ (3 * np.eye(n) - x.T @ x) / 2
    x = x / np.linalg.norm(x, axis=0)
    value = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (rows), by falling eigenvalue, of those that are above rounding."""
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((0, len(covariance)))
    value, vector = refine(covariance / trace, eigenvectors(covariance / trace))
    k = int((value[:most] > len(covariance) * _EPS).sum())
    return value[:k] * trace, vector[:, :k].T


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows whose vector is whole; written once."""
    v = F.col("embedding")
    entries = F.transform(v, lambda c: c.cast("double"))
    whole = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    bound = F.lit(float(2**53))
    x = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * SCALE, bound), -bound)).cast("long") + F.lit(OFFSET).cast("long"))
    found = materialize(rows.where(whole).select("vec_id", x.alias("x")), "whitening-vectors")
    lengths = sorted(((r["count"], r["length"]) for r in found.groupBy(F.size("x").alias("length")).count().collect()), reverse=True)
    return found.where(F.size("x") == lengths[0][1]) if lengths else found


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact(x: np.ndarray, factor: int, offset: int) -> np.ndarray:
    """The same integers, as Python's where ``x * factor - offset`` or a sum of rows may leave the range of long."""
    return x if int(np.abs(x).max(initial=0)) * factor + offset < 2**62 else x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's exact sums by dimension, as rows (i, j, total) with i 0."""
    total = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            x = _matrix(batch.column("x").slice(at, ROWS))
            part = _exact(x, ROWS, 0).sum(axis=0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        j = np.arange(len(total), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(j * 0), pa.array(j), pa.array([decimal.Decimal(t) for t in total], pa.decimal128(28, 0))], names=["i", "j", "total"])


def _products(name: str, means: np.ndarray | None):
    """A task's sums of products of centred entries (means None: of the entries themselves), as rows (i, j, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(name).slice(at, ROWS))
                if means is None:
                    part = x.sum(axis=0)[None, :]
                else:
                    x = x - means
                    part = x.T @ x
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "total"])

    return run


def _added(parts: DataFrame) -> list:
    return parts.groupBy("i", "j").agg(F.sum("total").alias("total")).orderBy("i", "j").collect()


def _summed(rows: DataFrame, name: str, d: int, means: np.ndarray | None = None) -> np.ndarray:
    """Sums over all rows: of the entries (length d), or with means of the products of centred entries (d x d)."""
    cells = _added(rows.select(name).mapInArrow(_products(name, means), "i int, j int, total double"))
    return np.array([c["total"] for c in cells]).reshape((d,) if means is None else (d, d))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    exact = _exact(x, n, max(map(abs, sums)))
    off = exact * n - np.array(sums, dtype=exact.dtype)
    if int(np.abs(off).max(initial=0)) ** 2 * len(sums) >= 2**62:
        off = off.astype(object)
    return [int(t) if t < 2**63 else None for t in (off * off).sum(axis=1)]


def _whitened(n: int, sums: list[int], means: np.ndarray, projection: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                x = _matrix(rows.column("x"))
                z = (x - means) @ projection.T
                offsets = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
                columns = [rows.column("vec_id"), pa.array(_deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    vectors = integer_vectors(rows)
    n, first = vectors.count(), vectors.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions: a matrix of {d} x {d} does not go through the driver")
    values, vectors_of = np.zeros(0), np.zeros((0, d))
    if n:
        sums = [int(r["total"]) for r in _added(vectors.select("x").mapInArrow(_sums, "i int, j int, total decimal(28,0)"))]
        means = np.array([s / n for s in sums])
        covariance = _summed(vectors, "x", d, means) / n
        values, vectors_of = components(covariance, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    projection = vectors_of / np.sqrt(values)[:, None]
    white = vectors.mapInArrow(_whitened(n, sums, means, projection), f"vec_id {kind}, deviation long, whitened array<double>")
    white = materialize(white, "whitened")
    mean = _summed(white, "whitened", k) / n
    error = float(np.abs(_summed(white, "whitened", k, mean) / n - np.eye(k)).max())
    explained = [float(v) for v in values / np.trace(covariance)]
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(explained)[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )
