"""Embedding whitening: vectors projected on the leading components of their covariance and scaled to unit variance.

Moments are added up in tasks and by entry across tasks; what reaches the driver is one d x d matrix (d at most `MOST_DIMENSIONS`). There the components come by spectral
divide-and-conquer: the orthogonal polar factor of the covariance less a shift, found by QR-based dynamically weighted Halley iteration (QDWH), gives the projector on all
components above the shift; the two invariant subspaces are split in turn, those without a wanted component left alone, until each holds one. The components (8 x d
numbers) are then sent to all tasks, which whiten their rows.

Entries c become x = floor(1024 * c) + 100000. Rows with a null vector, null or non-finite entries, or entries whose x is no long are left out; of vectors of several lengths
the most frequent length counts (of equally many the shortest) and others are left out, as are empty ones. Repeated rows and ids count each for itself, null ids stay. Components
whose eigenvalue is no more than rounding are left out, so equal vectors (or one alone) give no rows, nor does an empty table. `deviation` is null where it would exceed a long. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, MOST_DIMENSIONS = 1024, 100_000, 4096
_EPS = np.finfo(float).eps


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and e: arrays of doubles that are finite throughout."""
    e = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.filter("size(e) > 0 AND forall(e, c -> c IS NOT NULL AND abs(c) < 1e15)")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """x of each row, for vectors of one length."""
    lists = batch["e"]
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(lists), -1) + OFFSET


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """n and the sums S of the most frequent vector length."""

    def add(batches):
        found: dict[int, list] = {}
        for batch in batches:
            length = batch["l"].to_numpy()
            for d in np.unique(length):
                x = _matrix(batch.filter(pa.array(length == d)))
                have = found.setdefault(int(d), [0, np.zeros(d, dtype=np.int64)])
                have[0] += len(x)
                have[1] += x.sum(axis=0)
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s)], names=["l", "i", "n", "s"])

    added = vectors.withColumn("l", F.size("e")).mapInArrow(add, "l int, i int, n long, s long")
    lengths = added.filter("i = 0").groupBy("l").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l").first()
    if lengths is None:
        return 0, np.zeros(0, dtype=np.int64)
    if lengths.l > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {lengths.l} dimensions; at most {MOST_DIMENSIONS} are whitened")
    sums = added.filter(F.col("l") == lengths.l).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return lengths.n, np.array([r.s for r in sums], dtype=np.int64)


def _second_moments(vectors: DataFrame, rows_of, d: int) -> np.ndarray:
    """Sum of the outer products of what rows_of makes of each batch, and in the last row and column of the rows themselves."""

    def add(batches):
        g = np.zeros((d + 1, d + 1))
        for batch in batches:
            y = rows_of(batch)
            y = np.hstack([y, np.ones((len(y), 1))])
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["i", "g"])

    cells = vectors.mapInArrow(add, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d + 1, d + 1))
    got = cells.toArrow()
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return out


def polar_factor(a: np.ndarray, most: int = 20) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH; for a singular one its null space keeps values inside (-1, 1)."""
    x = a / np.linalg.norm(a)
    eye = np.eye(len(a))
    r = np.linalg.qr(x, mode="r")
    diagonal = np.abs(np.diag(r)).min()
    low = max(_EPS / 8, 0.9 / (np.linalg.norm(np.linalg.inv(r), 1) * np.sqrt(len(a)))) if diagonal > _EPS / 8 else _EPS / 8
    low = min(low, 1.0)
    for _ in range(most):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        w = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
        new = q / c * x + (p - q / c) / np.sqrt(c) * (w[: len(a)] @ w[len(a) :].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + c * square))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(_EPS) and abs(1 - low) < 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all eigenvalues are one but for rounding."""
    n, eye = len(a), np.eye(len(a))
    middle = np.median(np.diag(a))
    spread = np.linalg.norm(a - middle * eye) / np.sqrt(n)
    if spread <= 4 * _EPS * scale:
        return None
    draw = np.random.default_rng(n).standard_normal((n, n))
    for move in (0, 0.13, -0.13, 0.37, -0.37, 0.71, -0.71, 0.95, -0.95):
        shift = middle + move * spread
        u = polar_factor(a - shift * eye)
        above = (u + eye) / 2
        k = round(np.trace(above))
        if not 0 < k < n or np.linalg.norm(u @ u - eye) > 1e-10:
            continue
        upper = np.linalg.qr(above @ np.linalg.qr(above @ draw[:, :k])[0])[0]
        lower = (eye - above) @ draw[:, k:]
        lower -= upper @ (upper.T @ lower)
        lower = np.linalg.qr(lower)[0]
        lower = np.linalg.qr(lower - upper @ (upper.T @ lower))[0]
        return upper, lower
    return None


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = np.linalg.norm(v)

    def solve(basis: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray]]:
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        parts = _split(a, scale) if len(a) > 1 else None
        if parts is None:
            # One component, or several of one eigenvalue, of which any basis will do.
            return sorted(((a[i, i], basis[:, i]) for i in range(len(a))), key=lambda x: -x[0])[:wanted]
        upper = solve(basis @ parts[0], wanted)
        return upper + (solve(basis @ parts[1], wanted - len(upper)) if len(upper) < wanted else [])

    found = solve(np.eye(len(v)), min(wanted, len(v)))
    values = np.array([e for e, _ in found])
    some = values > len(v) * _EPS * max(values[0], 0.0)
    vectors = np.array([w / np.linalg.norm(w) for _, w in found]).reshape(len(found), -1)
    return values[some], vectors[some].T


def _exact_deviations(x: np.ndarray, n: int, s: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - s) ** 2 of each row, as longs; null where one is too great."""
    farthest = n * np.abs(x - s / n).max(initial=0) + n
    if farthest * farthest * x.shape[1] < 2.0**62:
        y = n * x - s
        return pa.array((y * y).sum(axis=1))
    y = n * x.astype(object) - s.astype(object)
    return pa.array([v if v < 1 << 63 else None for v in (y * y).sum(axis=1)], pa.int64())


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    usable = _usable(vectors)
    n, s = _sums(usable)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    d = len(s)
    one = usable.filter(F.size("e") == d)
    moments = _second_moments(one, lambda batch: _matrix(batch) - s / n, d)[:d, :d] / n
    values, axes = leading_components(moments, components)
    k = len(values)
    scaled = axes / np.sqrt(values)
    explained = values / np.trace(moments)
    g = _second_moments(one, lambda batch: (_matrix(batch) - s / n) @ scaled, k) / n
    error = float(np.abs(g[:k, :k] - np.outer(g[k, :k], g[k, :k]) - np.eye(k)).max(initial=0.0))

    def project(batches):
        for batch in batches:
            x = _matrix(batch)
            m = len(x)
            rows = pa.array(np.repeat(np.arange(m), k))
            columns = [batch["vec_id"].take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), _exact_deviations(x, n, s).take(rows)]
            columns += [pa.array(((x - s / n) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return one.mapInArrow(project, schema)
