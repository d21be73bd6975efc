"""Embedding whitening by incremental eigendecomposition.

Entries become whole numbers ``x = floor(1024 c) + 100000``, so counts, sums
and squared deviations are exact. Four passes over the vectors, none of
which shuffles them:

1. number of vectors and sum of every dimension, as whole numbers;
2. every partition keeps the spectrum (eigenvalues, eigenvectors) of the
   scatter of its rows. Rows are centred at the mean of their batch and
   added by rank-one updates: the new eigenvalues are the roots of the
   secular equation, after deflation of components without weight and of
   equal eigenvalues; the eigenvectors come from weights recomputed out of the
   roots, which keeps them orthogonal. A batch with more rows than dimensions is
   first turned into as many rows with the same scatter (the triangle of its QR
   factors). The difference of the means is one more update. Spectra of
   partitions are combined the same way, 16 at a time: the scaled eigenvectors
   of one are rank-one updates of the other;
3. Rayleigh-Ritz refinement: the covariance of the exactly centred vectors in
   the combined eigenvectors, summed on the executors; its small
   eigenproblem turns the eigenvectors to double precision;
4. the covariance of the whitened vectors, for ``identity_error``.

The driver holds a few matrices of dimension x dimension, whatever the
number of rows or partitions. A vector that a third of the rows share is
like any other: no key is grouped.

Rows are dropped if the vector is null, holds a null or an entry that is not
finite (entries of 2^38 and more in size count as such), or has another length than
most of the vectors that remain (on a tie the longer). Null and repeated ids
stay, a row each. An empty table, or one without a vector, gives an empty
result. With fewer dimensions than components there are as many components
as dimensions. ``whitened`` is null where a component has no variance (one
row, equal rows, fewer rows than components); ``explained`` is null without
any variance, and ``identity_error`` covers the components with variance.
``deviation`` is null where it is too large for a long. The sign of a component is
such that its largest entry is positive. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import as_batch, map_batches, sum_over_partitions
from semweave.session import materialize

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
FAN = 16  # spectra combined in one group
EPS = np.finfo(float).eps
LARGEST = 2.0**38


# ---------------------------------------------------------------- rank-one updates

def deflate(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(d, q, z, active)``: entries of ``z`` without weight and all but one of equal poles are set aside.

    ``z`` has length one, ``d`` ascends. Two poles that are closer than the
    rounding allows are rotated so that one of them has all the weight.
    """
    tol = 8 * EPS * max(abs(d[0]), abs(d[-1]), rho)
    z = np.where(rho * np.abs(z) <= tol, 0.0, z)
    active = np.flatnonzero(z)
    if len(active) > 1:
        a, b = active[:-1], active[1:]
        r2 = z[a] ** 2 + z[b] ** 2
        if (np.abs((d[b] - d[a]) * z[a] * z[b]) <= tol * r2).any():
            d, q, z = d.copy(), q.copy(), z.copy()
            last = active[0]
            for j in active[1:]:
                r = np.hypot(z[last], z[j])
                c, s = z[j] / r, z[last] / r
                if abs((d[j] - d[last]) * c * s) <= tol:
                    z[j], z[last] = r, 0.0
                    dl, dj = d[last], d[j]
                    d[last], d[j] = dl * c * c + dj * s * s, dl * s * s + dj * c * c
                    ql, qj = q[:, last].copy(), q[:, j].copy()
                    q[:, last], q[:, j] = c * ql - s * qj, s * ql + c * qj
                last = j
            active = np.flatnonzero(z)
    return d, q, z, active


def secular_roots(d: np.ndarray, w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho sum w_j / (d_j - x)``, one above each of the ascending poles ``d``.

    Returned as ``(pole, offset)``: the root is ``d[pole] + offset`` with the
    nearer pole as origin, so differences to the poles keep their digits. All roots
    are found together; a step interpolates both sides by one pole each and
    falls back on halving the bracket.
    """
    k = len(d)
    width = np.append(np.diff(d), rho * w.sum())
    middle = d + width / 2
    f = 1 + rho * (w / (d - middle[:, None])).sum(1)
    pole = np.arange(k)
    right = (f < 0) & (pole < k - 1)
    pole = pole + right
    gap = d[None, :] - d[pole][:, None]
    lo = np.where(right, -width / 2, 0.0)
    hi = np.where(right, 0.0, np.where(np.arange(k) < k - 1, width / 2, width))
    upper = ~right & (np.arange(k) == k - 1) & (f < 0)
    lo = np.where(upper, width / 2, lo)
    hi = np.where(~upper & (np.arange(k) == k - 1), width / 2, hi)
    mu = (lo + hi) / 2
    left = np.arange(k)[None, :] <= np.arange(k)[:, None]
    own = np.arange(k)
    nxt = np.minimum(own + 1, k - 1)
    done = np.zeros(k, bool)
    for _ in range(100):
        with np.errstate(all="ignore"):
            diff = gap - mu[:, None]
            t = rho * w / diff
            t2 = t / diff
            psi, phi = np.where(left, t, 0).sum(1), np.where(left, 0, t).sum(1)
            f = 1 + psi + phi
            done |= np.abs(f) <= 4 * EPS * (1 + np.abs(t).sum(1))
            lo, hi = np.where(f < 0, mu, lo), np.where(f >= 0, mu, hi)
            done |= hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi))
            if done.all():
                break
            dpsi, dphi = np.where(left, t2, 0).sum(1), np.where(left, 0, t2).sum(1)
            d1, d2 = diff[own, own], diff[own, nxt]
            s1 = d1 * d1 * dpsi
            c1 = 1 + psi - d1 * dpsi
            s2 = d2 * d2 * dphi
            c = c1 + phi - d2 * dphi
            a = c * (d1 + d2) + s1 + s2
            b = d1 * d2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = d1[-1] + s1[-1] / c1[-1]
            new = mu + step
            inside = np.isfinite(new) & (new > lo) & (new < hi)
        mu = np.where(done, mu, np.where(inside, new, (lo + hi) / 2))
    return pole, mu


def rank_one(d: np.ndarray, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``q diag(d) q' + u u'``."""
    z = q.T @ u
    rho = float(z @ z)
    if rho == 0 or not np.isfinite(rho):
        return d, q
    d, q, z, act = deflate(d, q, z / np.sqrt(rho), rho)
    k = len(act)
    if k == 0:
        return d, q
    poles, values = d[act], d.copy()
    pole, mu = secular_roots(poles, z[act] ** 2, rho)
    values[act] = poles[pole] + mu
    # the weights for which these roots are exact (Loewner), hence orthogonal vectors
    diff = mu[:, None] - (poles[None, :] - poles[pole][:, None])  # root j - pole i
    j, i = np.arange(k)[:, None], np.arange(k)[None, :]
    other = np.where(j < i, poles[:, None], np.append(poles[1:], 0.0)[:, None]) - poles[None, :]
    other[k - 1, :] = rho
    weight = np.sqrt(np.abs(np.prod(diff / other, axis=0))) * np.sign(z[act])
    with np.errstate(divide="ignore", invalid="ignore"):
        v = weight[:, None] / -diff.T
        v = np.where(np.isfinite(v), v, 0.0)
        v /= np.sqrt((v * v).sum(0))
    q = q.copy() if k < len(d) else q
    vectors = q[:, act] @ v
    if k < len(d):
        q[:, act] = vectors
    else:
        q = vectors
    order = np.argsort(values, kind="stable")
    return values[order], q[:, order]


class Spectrum:
    """Number, sum and spectrum of the scatter (about the mean) of some vectors."""

    def __init__(self, size: int):
        self.n, self.total = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def _join(self, n: int, total: np.ndarray, updates: np.ndarray) -> None:
        for u in updates:
            self.values, self.vectors = rank_one(self.values, self.vectors, u)
        if self.n and n:
            apart = self.total / self.n - total / n
            self.values, self.vectors = rank_one(self.values, self.vectors,
                                                 apart * np.sqrt(self.n * n / (self.n + n)))
        self.n, self.total = self.n + n, self.total + total

    def add_rows(self, y: np.ndarray) -> None:
        if len(y):
            centred = y - y.mean(0)
            self._join(len(y), y.sum(0), centred if len(y) <= y.shape[1] else np.linalg.qr(centred, mode="r"))

    def add(self, other: Spectrum) -> None:
        self._join(other.n, other.total, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def to_bytes(self) -> bytes:
        return np.concatenate([[float(self.n)], self.total, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, m: bytes, size: int) -> Spectrum:
        a, out = np.frombuffer(m), cls(size)
        out.n, out.total, out.values = int(a[0]), a[1:size + 1], a[size + 1:2 * size + 1]
        out.vectors = a[2 * size + 1:].reshape(size, size)
        return out


# ---------------------------------------------------------------- passes over the vectors

def whole(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def usable(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row numbers, x)`` of the vectors of this length without null or infinite entries."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(rows)).flatten()
    if flat.null_count:
        flat = pc.fill_null(flat, float("nan"))
    c = flat.to_numpy(zero_copy_only=False).reshape(len(rows), size)
    good = (np.abs(c) < LARGEST).all(1)
    return rows[good], whole(c[good])


def sums(slim: DataFrame) -> tuple[int, int, list[int]]:
    """``(length, n, sums)`` of the most frequent length of a usable vector (0 without one)."""

    def add_up(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        column, out = b.column(1), []
        for size in set(pc.fill_null(pc.list_value_length(column), 0).to_pylist()) - {0}:
            rows, x = usable(column, size)
            if len(rows):
                out.append(as_batch({"size": [size] * (size + 1), "i": range(-1, size),
                                     "s": [len(rows), *x.sum(0).tolist()]}, schema))
        return pa.Table.from_batches(out, schema).combine_chunks().to_batches() if out else []

    schema = pa.schema([("size", pa.int32()), ("i", pa.int32()), ("s", pa.int64())])
    parts = _flat(slim, add_up, "size int, i int, s long")
    total = materialize(parts.groupBy("size", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "whiten_sums")
    best = total.where("i = -1").orderBy(F.desc("s"), F.desc("size")).limit(1).collect()
    if not best:
        return 0, 0, []
    size = best[0]["size"]
    s = {r["i"]: int(r["s"]) for r in total.where(F.col("size") == size).collect()}
    return size, s[-1], [s[i] for i in range(size)]


def _flat(df: DataFrame, fn, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, ddl)


def combined_spectrum(slim: DataFrame, size: int, middle: np.ndarray) -> Spectrum:
    """The spectrum of all rows about ``middle`` (whole numbers near the mean)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum(size)
        for b in batches:
            own.add_rows((usable(b.column(1), size)[1] - middle).astype(float))
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([own.to_bytes()], pa.binary())], ["lane", "m"])

    def together(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by("lane")
        out = Spectrum(size)
        for k, m in enumerate(tbl.column("m")):
            s = Spectrum.from_bytes(m.as_py(), size)
            if k:
                out.add(s)
            else:
                out = s
        return pa.table({"lane": pa.array([tbl.column("lane")[0].as_py()], pa.int32()),
                         "m": pa.array([out.to_bytes()], pa.binary())})

    parts = materialize(slim.mapInArrow(build, "lane int, m binary"), "whiten_spectra")
    lanes = parts.agg(F.max("lane")).first()[0] + 1
    while lanes > 1:
        parts = parts.withColumn("lane", F.expr(f"lane div {FAN}").cast("int")).groupBy("lane").applyInArrow(
            together, "lane int, m binary")
        lanes = -(-lanes // FAN)
    return Spectrum.from_bytes(parts.first()["m"], size)


class Centre:
    """Exact centring of whole-number vectors: ``n x - S``."""

    def __init__(self, n: int, s: list[int]):
        self.n, self.s = n, s
        self.wide = n * max([OFFSET, *(abs(v) // n + 1 for v in s)]) >= 2**60

    def exact(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        if self.wide or self.n * int(np.abs(x).max()) >= 2**61:
            return x.astype(object) * self.n - np.array(self.s, object)
        return x * self.n - np.array(self.s, np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n``, rounded once."""
        return self.exact(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n x - S)^2`` per row; None beyond a long."""
        e = self.exact(x)
        if not len(e):
            return []
        if int(np.abs(e).max()) ** 2 * e.shape[1] >= 2**63:
            e = e.astype(object)
        return [v if v < 2**63 else None for v in (e * e).sum(1).tolist()]


def rayleigh_ritz(slim: DataFrame, size: int, centre: Centre, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the covariance in the span of ``basis``."""
    basis = np.linalg.qr(basis)[0]

    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        p = centre(usable(b.column(1), size)[1]).reshape(-1, size) @ basis
        total += (p.T @ p).ravel()

    h = sum_over_partitions(slim, basis.shape[1] ** 2, add).reshape(basis.shape[1], -1) / centre.n
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values, kind="stable")
    vectors = basis @ turn[:, order]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return np.maximum(values[order], 0), vectors * np.where(largest < 0, -1.0, 1.0)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per usable row and component."""
    slim = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ddl = ("id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
    size, n, s = sums(slim)
    if not n:
        return embeddings.sparkSession.createDataFrame([], ddl).withColumnRenamed("id", id_col)
    centre = Centre(n, s)
    middle = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    values, vectors = rayleigh_ritz(slim, size, centre, combined_spectrum(slim, size, middle).vectors)
    k = min(components, size)
    spread = values[:k] > size * EPS * values[0]
    scale = np.where(spread, np.sqrt(np.where(spread, values[:k], 1.0)), np.nan)
    axes, trace = vectors[:, :k] / scale, float(values.sum())
    live = np.flatnonzero(spread)

    def moments(total: np.ndarray, b: pa.RecordBatch) -> None:
        w = centre(usable(b.column(1), size)[1]).reshape(-1, size) @ axes[:, live]
        total[:len(live)] += w.sum(0)
        total[len(live):] += (w.T @ w).ravel()

    error = None
    if len(live):
        m = sum_over_partitions(slim, len(live) * (len(live) + 1), moments) / n
        mean, second = m[:len(live)], m[len(live):].reshape(len(live), -1)
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(live))).max())
    explained = [float(e / trace) if trace > 0 else None for e in values[:k]]
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, x = usable(b.column(1), size)
        w = (centre(x).reshape(-1, size) @ axes).ravel()
        ids = b.column(0).take(pa.array(np.repeat(rows, k)))
        apart = pa.array(centre.deviation(x), pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(w), n)),
             apart.take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(w, mask=np.isnan(w)),
             pa.array(explained * len(rows), pa.float64()), pa.array([error] * len(w), pa.float64())], schema=schema)

    return map_batches(slim, project, ddl).withColumnRenamed("id", id_col)
