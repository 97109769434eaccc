"""Embedding whitening on the leading eigenvectors of the vectors' covariance,
found by Jacobi-Davidson without forming the matrix.

A vector's entries c become integers floor(``scale`` * c) + ``shift``, kept as
packed blocks of rows.  Sums are exact, so every entry is centred exactly but for one
rounding.  The only work on the data is the product V Q = sum (x - m) ((x - m)' Q) / n of
the covariance with a few columns: each task adds up its blocks' d x b share.

Outer steps (for all wanted pairs at once): Rayleigh-Ritz on the search space,
whose products with V are kept; pairs are locked from the largest on
as soon as their residual is at rounding level; each pair that is not locked gets a correction t
from (I - QQ')(V - theta I)(I - QQ') t = -r, with Q the locked and the current Ritz
vectors, solved by a few steps of MINRES; all columns' steps share one
product.  The corrections, orthogonalised against everything held, extend the space; a full space
is restarted from its best Ritz vectors.  A last Rayleigh-Ritz step with fresh
products orders the locked vectors.  The driver holds d x b matrices only.

Defined results: vectors that are null, empty or hold null or non-finite
entries are left out, as are those of another length than the most frequent
one (of equally frequent ones, the longer); entries beyond 2**52 / ``scale`` count
as that.  Directions without variance (within rounding) have no row, so that
one vector, or equal ones, give no rows.  A deviation beyond a long is null.
Null and repeated ids are rows like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import pack, stored, unpack

SCALE, SHIFT = 1024, 100_000
COMPONENTS, SPACE, INNER, STEPS = 8, 6, 8, 200
BLOCK_ROWS = 8192
EPS = float(np.finfo(np.float64).eps)


# ------------------------------------------------------------ the data


def blocks(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """(blocks, width): stored rows of packed ids (null: a mask) and integer vectors."""
    top = float(1 << 52)
    whole = lambda v: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), v.cast("double") * scale))).cast("long") + shift
    good = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    valid = rows.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).where("v is not null and size(v) > 0").where(F.coalesce(good, F.lit(False)))
    first = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = int(first["d"]) if first else 0
    kept = valid.where(F.size("v") == width).select("i", F.transform("v", whole).alias("x"))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                ids, x = part.column("i"), part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = [pack(ids.fill_null(0).to_numpy(zero_copy_only=False)), pack(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)), pack(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in row], names=["ids", "null", "x"])

    return stored(kept.mapInArrow(run, "ids binary, null binary, x binary"), "vectors"), width


class Vectors:
    """The stored vectors and their exact sums."""

    def __init__(self, table: DataFrame, width: int):
        self.table, self.width, self.jobs = table, width, 0
        cores = max(1, table.sparkSession.sparkContext.defaultParallelism)
        self.tasks = min(4 * cores, max(1, table.rdd.getNumPartitions()))

        def sums(batches):
            n, s = 0, [0] * width
            for x in _matrices(batches, width):
                n += len(x)
                big = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
                s = [a + int(b) for a, b in zip(s, x.astype(object).sum(axis=0) if big else x.sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(v) for v in s]], pa.list_(pa.string()))], names=["n", "s"])

        parts = table.select("x").coalesce(self.tasks).mapInArrow(sums, "n long, s array<string>").collect() if width else []
        self.n = sum(r.n for r in parts)
        self.sums = [sum(int(r.s[j]) for r in parts) for j in range(width)]
        self.whole = np.array([s // max(1, self.n) for s in self.sums], np.int64)
        self.rest = np.array([(s - self.n * (s // self.n)) / self.n for s in self.sums]) if self.n else np.zeros(width)

    def _add_up(self, shape: tuple[int, ...], share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all centred blocks of ``share``: one row of ``shape`` per task reaches the driver."""
        whole, rest, width = self.whole, self.rest, self.width

        def run(batches):
            total = np.zeros(shape)
            for x in _matrices(batches, width):
                total += share((x - whole) - rest)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["a"])

        self.jobs += 1
        parts = self.table.select("x").coalesce(self.tasks).mapInArrow(run, "a binary").collect()
        return sum((np.frombuffer(r.a).reshape(shape) for r in parts), np.zeros(shape))

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q for a few columns q."""
        return self._add_up(q.shape, lambda c: c.T @ (c @ q)) / self.n

    def trace(self) -> float:
        return float(self._add_up((1,), lambda c: np.array([(c * c).sum()]))[0]) / self.n

    def covariance_of(self, project: np.ndarray) -> np.ndarray:
        """Covariance of the projected vectors, centred on their own means."""
        k = project.shape[1]
        both = self._add_up((k + 1, k), lambda c: np.vstack([(p := c @ project).T @ p, p.sum(axis=0)])) / self.n
        return both[:-1] - np.outer(both[-1], both[-1])


def _matrices(batches, width: int):
    for batch in batches:
        for b in batch.column("x").to_pylist():
            yield unpack(b).reshape(-1, width)


# ------------------------------------------------------ the eigenvectors


def _outside(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t`` adds to the orthonormal ``q``."""
    for _ in range(2):
        t = t - q @ (q.T @ t)
        norm = np.linalg.norm(t, axis=0)
        t = t[:, norm > 0] / norm[norm > 0]
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-8 * max(1.0, s.max(initial=0.0))]
    t = t - q @ (q.T @ t)
    return np.linalg.qr(t)[0]


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, close: float) -> np.ndarray:
    """Approximate solutions of A_i x_i = b_i, column by column; ``apply`` takes all columns at once.
    Lanczos with Givens rotations, as published by Paige and Saunders."""
    x, v_old = np.zeros_like(b), np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    size = beta.copy()
    live = beta > 0
    v = np.divide(b, beta, out=np.zeros_like(b), where=live)
    eta, c, c_old, s, s_old = beta.copy(), *np.ones((2, b.shape[1])), *np.zeros((2, b.shape[1]))
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - v * alpha - v_old * beta
        after = np.linalg.norm(p, axis=0)
        d = c * alpha - c_old * s * beta
        r1 = np.hypot(d, after)
        r2, r3 = s * alpha + c_old * c * beta, s_old * beta
        live &= r1 > 0
        r = np.where(r1 > 0, r1, 1.0)
        c_old, s_old, c, s = c, s, d / r, after / r
        w, w_old = (v - w_old * r3 - w * r2) / r, w
        x = x + np.where(live, w * (c * eta), 0.0)
        eta = -s * eta
        live &= (after > EPS * np.maximum(size, 1e-300)) & (np.abs(eta) > close * size)
        v_old, v = v, np.divide(p, after, out=np.zeros_like(p), where=after > 0)
        beta = after
    return x


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, k: int, space: int = SPACE, inner: int = INNER, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residual norms) of the ``k`` largest pairs of a
    symmetric operator, by falling eigenvalue."""
    k = min(k, width)
    rng = np.random.default_rng(12)
    locked = np.zeros((width, 0))
    basis = np.linalg.qr(rng.standard_normal((width, min(width, 2 * k))))[0]
    image = times(basis)
    for _ in range(steps):
        theta, y = np.linalg.eigh((h := basis.T @ image) / 2 + h.T / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        want = k - locked.shape[1]
        residual = image[:, :want] - basis[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        norm = np.linalg.norm(residual, axis=0)
        top = max(top, theta[0]) if locked.shape[1] else theta[0]  # the norm of V, from the first pair on
        full = locked.shape[1] + basis.shape[1] >= width
        done = norm <= 4 * EPS * width**0.5 * abs(top)
        m = want if done.all() or full else int(np.argmin(done))
        if m:
            locked = np.hstack([locked, basis[:, :m]])
            basis, image, theta, residual = basis[:, m:], image[:, m:], theta[m:], residual[:, m:]
            locked = np.linalg.qr(locked)[0]
        if locked.shape[1] >= k:
            break
        if basis.shape[1] + residual.shape[1] > space * k:
            basis, image, theta = basis[:, :2 * k], image[:, :2 * k], theta[:2 * k]
        now = theta[:residual.shape[1]]
        held = np.hstack([locked, basis[:, :residual.shape[1]]])
        out = lambda z: z - held @ (held.T @ z)  # noqa: B023, E731
        t = minres(lambda z: out(times(z) - z * now), -out(residual), inner, 0.02)  # noqa: B023
        t = _outside(np.hstack([locked, basis]), np.where(np.linalg.norm(t, axis=0) > 0, t, residual))
        if not t.shape[1]:  # nothing new to gain: a fresh direction
            t = _outside(np.hstack([locked, basis]), rng.standard_normal((width, 1)))
        basis, image = np.hstack([basis, t]), np.hstack([image, times(t)])
    else:
        raise ArithmeticError(f"only {locked.shape[1]} of {k} pairs reached double precision")
    image = times(locked)
    theta, y = np.linalg.eigh((h := locked.T @ image) / 2 + h.T / 2)
    theta, y = theta[::-1], y[:, ::-1]
    vectors = locked @ y
    vectors /= np.linalg.norm(vectors, axis=0)
    return theta, vectors, np.linalg.norm(image @ y - vectors * theta, axis=0)


# ----------------------------------------------------------- the operator


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, dict]:
    """(result, model).  result: ``vec_id, component, n, deviation, whitened,
    explained, identity_error`` per vector and component.  model: eigenvalues,
    vectors, mean, residuals (relative to the largest eigenvalue), trace, products."""
    table, width = blocks(rows, id_col, vec_col, scale, shift)
    data = Vectors(table, width)
    n, sums, whole, rest = data.n, data.sums, data.whole, data.rest
    trace = data.trace() if n else 0.0
    values, vectors, residuals = leading(data.times, width, components) if trace > 0 else (np.zeros(0), np.zeros((width, 0)), np.zeros(0))
    good = values > width * EPS * max(trace, 0.0) * 4
    values, vectors, residuals = values[good], vectors[:, good], residuals[good]
    if len(values):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    project = vectors / np.sqrt(values)
    error = float(np.abs(data.covariance_of(project) - np.eye(len(values))).max()) if len(values) else 0.0
    k, share = len(values), values / trace if trace > 0 else values
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for ids, null, packed in zip(*(batch.column(c).to_pylist() for c in ("ids", "null", "x"))):
                x = unpack(packed).reshape(-1, width)
                ids, null = unpack(ids), unpack(null) > 0
                part = x - whole
                off = [s - n * int(w) for s, w in zip(sums, whole)]
                if (float(np.abs(part).max(initial=0)) + 1) ** 2 * float(n) ** 2 * width < float(1 << 62):
                    deviation = pa.array(((part * n - np.array(off, np.int64)) ** 2).sum(axis=1))
                else:
                    exact = [sum((int(a) * n - o) ** 2 for a, o in zip(r, off)) for r in part]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                z = (part - rest) @ project
                at = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [pa.array(ids, mask=null).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
                           deviation.take(at), pa.array(z.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * k, error))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names=names)

    out = table.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model = {"values": values, "vectors": vectors, "mean": whole + rest, "residuals": residuals / (values[0] if k else 1.0), "trace": trace, "products": data.jobs}
    return out, model
