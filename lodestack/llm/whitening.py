"""Embedding whitening: mean and covariance by Welford's updates, eigenvectors by the symmetric QR algorithm.

Components c become whole numbers x = floor(256 * c). The fit list holds each distinct vector x once. Each task streams its part of the
list through Welford's rank-one updates M <- M + (x - mean before)(x - mean after)', a block of rows at a time: the running
means of the block's rows come from exact whole-number sums, and their rank-one terms are added as one matrix product. The tasks'
states (n, sums, mean, M) are merged by the parallel update M = Ma + Mb + (na nb / n) d d', level by level; their size depends on the number of
dimensions only. The driver solves the d x d eigenproblem: Householder reflections to tridiagonal form, then implicit QR steps with
Wilkinson's shift. One more pass over the list measures the covariance of the whitened vectors.

Rows whose vector is null or holds null or non-finite components take no part. Shorter vectors count as filled with zeros up to the
longest one's length. x stays in 64 bits (larger values become the largest). A deviation is computed in whole numbers of any size and,
beyond 64 bits, returned as the largest long. Components without variance (an eigenvalue of at most d * 2**-50 of the trace) can't be scaled to 1 and
are left out, so a list of one distinct vector gives no rows. Rows that repeat an id, null ids too, are projected each; columns other than the named ones are ignored; an empty
table gives none. The d x d state bounds d: it is meant for some thousands of dimensions at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, merged, pack, spent, unpack

TOP, BLOCK = 4, 2048


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part, in their own length."""
    e = F.col(embedding)
    fine = e.isNotNull() & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(fine).select(F.col(vec_id).alias("vec_id"), F.transform(e, lambda c: F.floor(c.cast("double") * 256.0).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


class Welford:
    """Count, exact sums, mean and centred products of the rows seen so far."""

    def __init__(self, dims: int) -> None:
        self.n, self.sums, self.mean, self.m = 0, np.zeros(dims, object), np.zeros(dims), np.zeros((dims, dims))

    def add(self, x: np.ndarray) -> None:
        """Rank-one updates by the rows of x, in their order."""
        for k in range(0, len(x), BLOCK):
            part = x[k : k + BLOCK]
            shift = np.rint(self.mean if self.n else part[0].astype(float))  # running sums relative to it stay small
            y = part - shift
            seen = self.n + np.arange(1, len(y) + 1)[:, None]
            mean = ((self.mean - shift) * self.n + np.cumsum(y, 0)) / seen
            before = np.vstack([(self.mean - shift)[None], mean[:-1]])
            self.m += (y - before).T @ (y - mean)
            self.n += len(y)
            self.mean = mean[-1] + shift
            self.sums = self.sums + _sums(part)

    def merge(self, other: Welford) -> None:
        if not other.n:
            return
        n = self.n + other.n
        d = other.mean - self.mean
        self.m += other.m + np.outer(d, d) * (self.n * other.n / n)
        self.mean = self.mean + d * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def pack(self) -> bytes:
        sums = "\n".join(map(str, self.sums)).encode()
        return pack(np.array([self.n]), np.frombuffer(sums, np.uint8), self.mean, self.m.ravel())

    @classmethod
    def unpack(cls, blob: bytes) -> Welford:
        n, sums, mean, m = unpack(blob, np.int64, np.uint8, np.float64, np.float64)
        out = cls(len(mean))
        out.n, out.mean, out.m = int(n[0]), mean.copy(), m.reshape(len(mean), -1).copy()
        if len(mean):
            out.sums = np.array([int(s) for s in sums.tobytes().split(b"\n")], object)
        return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python's whole numbers; float rows give whole floats."""
    if x.dtype == np.int64 and (not x.size or np.abs(x.astype(float)).max() < 2.0**62 / len(x)):
        return x.sum(0).astype(object)
    return x.astype(object).sum(0) if x.dtype == np.int64 else np.zeros(x.shape[1], object)


def _merge(blobs: Iterator[bytes]) -> bytes:
    state = Welford.unpack(next(blobs))
    for b in blobs:
        state.merge(Welford.unpack(b))
    return state.pack()


def moments(rows: DataFrame, dims: int) -> Welford:
    """The Welford state of a column x of vectors of one length."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Welford(dims)
        for b in batches:
            if b.num_rows:
                state.add(_matrix(b.column(0), dims))
        if state.n:
            yield pa.RecordBatch.from_arrays([pa.array([state.pack()], pa.binary())], names=["blob"])

    blob = merged(rows.select("x").mapInArrow(stream, "blob binary"), _merge)
    return Welford(dims) if blob is None else Welford.unpack(blob)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with a = Q T Q', by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix: implicit QR steps on its tridiagonal form."""
    d, e, q = tridiagonal(a)
    end, eps = len(d) - 1, np.finfo(float).eps
    while end > 0:
        small = np.abs(e[:end]) <= eps * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))
        e[:end][small] = 0.0
        if not e[end - 1]:
            end -= 1
            continue
        begin = end - 1
        while begin > 0 and e[begin - 1]:
            begin -= 1
        # Wilkinson's shift: the eigenvalue of the last 2 x 2 block that is nearer to its corner.
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[begin] - shift, e[begin]
        for k in range(begin, end):  # chase the bulge down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            p, w, o = d[k], d[k + 1], e[k]
            d[k], d[k + 1], e[k] = c * c * p + 2 * c * s * o + s * s * w, s * s * p - 2 * c * s * o + c * c * w, c * s * (w - p) + (c * c - s * s) * o
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            both = q[:, k : k + 2]
            q[:, k], q[:, k + 1] = c * both[:, 0] + s * both[:, 1], -s * both[:, 0] + c * both[:, 1]
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


class Whitening:
    """The fitted transform: n, sums, components over roots of their eigenvalues, and shares of the trace."""

    def __init__(self, state: Welford, top: int = TOP) -> None:
        dims = len(state.mean)
        v = (state.m + state.m.T) / 2 / max(state.n, 1)
        trace = float(np.trace(v))
        values, vectors = symmetric_qr(v) if dims else (np.zeros(0), np.zeros((0, 0)))
        k = int((values[:top] > dims * 2.0**-50 * trace).sum()) if trace > 0 else 0
        self.n, self.sums, self.dims = state.n, [int(s) for s in state.sums], dims
        self.mean, self.scaled, self.explained = state.mean, vectors[:, :k] / np.sqrt(values[:k]), values[:k] / (trace or 1.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2, exact."""
        largest = self.n * (np.abs(x.astype(float)).max(initial=0.0) + max((abs(s) / self.n for s in self.sums), default=0.0))
        if largest**2 * self.dims < 2.0**62:
            y = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return [min(int(s), 2**63 - 1) for s in (y * y).sum(1)]


def fit(points: DataFrame, dims: int, top: int = TOP) -> tuple[Whitening, float]:
    """The transform learned from the distinct vectors of ``points`` (x) and how far the whitened list's covariance is from identity."""
    listed = cut(points.select("x").distinct(), "fit")
    w = Whitening(moments(listed, dims), top)
    k = len(w.explained)
    if not k:
        spent(listed)
        return w, 0.0
    sent = listed.sparkSession.sparkContext.broadcast(w)  # d x top numbers

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = sent.value.project(_matrix(b.column(0), dims))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), k).cast(pa.list_(pa.float64()))], names=["x"])

    state = moments(listed.mapInArrow(whiten, "x array<double>"), k)
    spent(listed)
    return w, float(np.abs(state.m / state.n - np.eye(k)).max())


def digest(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row that takes part and component up to ``top``."""
    own = whole(vectors)
    dims = own.agg(F.max(F.size("x"))).first()[0] or 0
    pad = F.when(F.size("x") == dims, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    rows = own.select("vec_id", pad.alias("x"))
    w, error = fit(rows, dims, top)
    k = len(w.explained)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    kind = f"vec_id {id_type}, deviation long, z array<double>"
    sent = vectors.sparkSession.sparkContext.broadcast(w)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            z = pa.FixedSizeListArray.from_arrays(pa.array(sent.value.project(x).ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.deviations(x), pa.int64()), z], names=["vec_id", "deviation", "z"])

    out = rows.mapInArrow(project, kind) if k else rows.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("z"))
    share = F.element_at(F.array(*[F.lit(float(e)) for e in w.explained]), F.col("component")) if k else F.lit(0.0)
    each = out.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return each.select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
