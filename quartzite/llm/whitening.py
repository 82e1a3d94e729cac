"""Whitening of vectors by their covariance.

1. Every usable vector is quantised, each entry c to the integer floor(64 * c), and packed into the
   narrowest integers that hold it, so that equal vectors are equal bytes; a distinct over these
   bytes, combined within tasks first, is the fit list.
2. Welford: each task streams over its rows and keeps count, mean and the centred second moment.
   Row i moves the mean by d / i and adds (i - 1) / i * d d', d being its distance to the mean of
   the rows before it; the rank-one updates of a batch are added in one matrix product.
3. States are merged by the parallel update formula, `fan` at a time, in as many rounds as needed:
   no task or driver holds more than `fan` states of d * d numbers.
4. The covariance is reduced to a tridiagonal matrix by Householder reflections and solved by
   implicitly shifted symmetric QR steps; the model (a mean and `most` vectors) goes to all tasks.
5. Whitened rows of the fit list are put through steps 2 and 3 again: the largest deviation of
   their covariance from the identity is the error.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; the
empty vector has no components and so gives no row. Vectors of each length are fitted by
themselves. Entries beyond 2**53 after scaling count as 2**53. A component whose eigenvalue is 0
to double precision (constant or linearly dependent entries, fewer vectors than entries) has a
null `whitened` and doesn't count in the error. `deviation` is null where it doesn't fit in a long.
Repeated rows give rows each and count once in the fit; an empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

SCALE, BASE = 64, 1_000_000
_TYPES = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]
_STATE = "d int, n long, high binary, low binary, mean binary, moment binary"


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of the usable vectors of a batch, one pair for each length."""
    valid = np.asarray(column.is_valid())
    sizes = np.diff(column.offsets.to_numpy())
    first = column.offsets.to_numpy()[:-1]
    flat = column.values
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become nan
    for d in np.unique(sizes[valid]):
        if d == 0:
            continue
        at = np.flatnonzero(valid & (sizes == d))
        for k in range(0, len(at), max(1, (1 << 21) // int(d))):
            some = at[k : k + max(1, (1 << 21) // int(d))]
            m = values[first[some][:, None] + np.arange(d)]
            fine = np.isfinite(m).all(axis=1)
            yield some[fine], m[fine]


def _quantise(m: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(m * SCALE), -(2.0**53), 2.0**53).astype(np.int64)


def _pack(q: np.ndarray) -> list[bytes]:
    """Each row in the narrowest type that holds it, after a byte that says which."""
    low, high = q.min(axis=1), q.max(axis=1)
    kind = np.full(len(q), 3)
    for k in (2, 1, 0):
        info = np.iinfo(_TYPES[k])
        kind[(low >= info.min) & (high <= info.max)] = k
    out: list[bytes] = [b""] * len(q)
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        body = np.ascontiguousarray(q[rows].astype(_TYPES[k])).view(np.uint8).reshape(len(rows), -1)
        body = np.concatenate([np.full((len(rows), 1), k, np.uint8), body], axis=1)
        for i, line in zip(rows, body, strict=True):
            out[i] = line.tobytes()
    return out


def _unpack(codes: pa.Array) -> Iterator[np.ndarray]:
    """The integers of packed rows, as matrices of one type and length each."""
    large = codes.cast(pa.large_binary())
    if not len(large):
        return
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    first, sizes = offsets[:-1], np.diff(offsets)
    raw = np.frombuffer(large.buffers()[2], np.uint8)
    kinds = raw[first]
    for k, size in sorted({*zip(kinds.tolist(), sizes.tolist(), strict=True)}):
        at = first[(kinds == k) & (sizes == size)]
        body = raw[at[:, None] + np.arange(1, size)]
        yield np.ascontiguousarray(body).view(_TYPES[k]).astype(np.int64)


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, m in _rows(b.column(0)):
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array(_pack(_quantise(m)), pa.binary())], ["code"])


class Moments:
    """Count, exact sums, mean and centred second moment of vectors of one length."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.moment = 0, np.zeros(d), np.zeros((d, d))
        self.high, self.low = np.zeros(d, np.int64), np.zeros(d, np.int64)  # sums in two parts: 2**26 * high + low

    def update(self, x: np.ndarray, exact: bool = True) -> None:
        """Welford's rank-one updates by the rows of x, one after the other; their products are added at once."""
        if exact:
            self.high += (x >> 26).sum(axis=0)
            self.low += (x & (2**26 - 1)).sum(axis=0)
        y = x.astype(float) - (self.mean if self.n else x[0].astype(float))
        before = self.n + np.arange(len(x))
        sums = np.zeros_like(y)
        np.cumsum(y[:-1], axis=0, out=sums[1:])
        d = y - sums / np.maximum(before, 1)[:, None]  # the distance of each row to the mean of all before it
        self.moment += (d * (before / (before + 1))[:, None]).T @ d
        self.mean = (self.mean if self.n else x[0].astype(float)) + y.sum(axis=0) / (self.n + len(x))
        self.n += len(x)

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        if other.n:
            d = other.mean - self.mean
            self.moment += other.moment + np.outer(d, d) * (self.n * other.n / n)
            self.mean = self.mean + d * (other.n / n)
            self.high, self.low, self.n = self.high + other.high, self.low + other.low, n

    def row(self) -> dict:
        return {"d": len(self.mean), "n": self.n} | {k: getattr(self, k).tobytes() for k in ("high", "low", "mean", "moment")}

    @classmethod
    def of(cls, row: dict) -> Moments:
        out = cls(row["d"])
        out.n = row["n"]
        out.high, out.low = np.frombuffer(row["high"], np.int64), np.frombuffer(row["low"], np.int64)
        out.mean, out.moment = np.frombuffer(row["mean"]).copy(), np.frombuffer(row["moment"]).reshape(row["d"], -1).copy()
        return out

    def sums(self) -> list[int]:
        return [(int(h) << 26) + int(x) for h, x in zip(self.high, self.low, strict=True)]


def _states(found: dict[int, Moments]) -> pa.RecordBatch:
    fields = [("d", pa.int32()), ("n", pa.int64()), *[(k, pa.binary()) for k in ("high", "low", "mean", "moment")]]
    return pa.RecordBatch.from_pylist([m.row() for m in found.values()], pa.schema(fields))


def _streamed(rows):
    """A task's states: rows(batch) yields matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for b in batches:
            for m, exact in rows(b):
                for k in range(0, len(m), 4096):
                    if m.shape[1] not in found:
                        found[m.shape[1]] = Moments(m.shape[1])
                    found[m.shape[1]].update(m[k : k + 4096], exact)
        for d, m in found.items():
            yield _states({d: m})

    return run


def _merged(states: pa.Table) -> pa.Table:
    total: Moments | None = None
    for k in range(states.num_rows):
        one = Moments.of({c: states[c][k].as_py() for c in states.column_names if c not in ("turn", "at")})
        if total is None:
            total = one
        else:
            total.merge(one)
    return pa.Table.from_batches([_states({0: total})])


def moments(fit: DataFrame, rows, fan: int = 16) -> dict[int, Moments]:
    """The merged state of each length. rows(batch) yields (matrix, whether it holds integers)."""
    made = written(fit.mapInArrow(_streamed(rows), _STATE), "whitening-states", small=True)
    while True:
        most = made.groupBy("d").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return {r["d"]: Moments.of(r.asDict()) for r in made.collect()}  # a row for each length
        parts = -(-most // fan)
        dealt = made.withColumn("turn", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
        made = written(dealt.groupBy("d", "turn").applyInArrow(_merged, _STATE), "whitening-states", small=True)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with q' a q tridiagonal, by Householder reflections."""
    a = a.astype(float).copy()
    n = len(a)
    q = np.eye(n)
    nothing = 1e-3 * np.finfo(float).eps * np.abs(a).max(initial=0.0)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm <= nothing:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors in columns, by QR steps with Wilkinson's shift."""
    d, e, q = tridiagonal(a)
    z = np.ascontiguousarray(q.T)
    high = len(d) - 1
    eps = np.finfo(float).eps
    while high > 0:
        small = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        zero = np.flatnonzero(e[:high] == 0)
        low = int(zero[-1]) + 1 if len(zero) else 0
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, y = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, y)
            c, s = (x / r, y / r) if r else (1.0, 0.0)
            unit = np.hypot(c, s)  # not 1 where x and y are all but 0
            c, s = c / unit, s / unit
            if k > low:
                e[k - 1] = r
            p, o, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * t, s * s * p - 2 * c * s * o + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * o
            z[k], z[k + 1] = c * z[k] + s * z[k + 1], c * z[k + 1] - s * z[k]
            if k < high - 1:
                x, y = e[k], s * e[k + 1]
                e[k + 1] *= c
    order = np.argsort(-d, kind="stable")
    return d[order], z[order].T


def _model(m: Moments, most: int) -> dict:
    """What scoring needs: sums, projection (entries x components, scaled; nan where the eigenvalue is 0), explained shares."""
    values, vectors = symmetric_eigen(m.moment / m.n)
    d = len(values)
    values, vectors, trace = values[:most], vectors[:, :most], float(np.trace(m.moment) / m.n)
    there = values > d * np.finfo(float).eps * max(values[0], 0.0)
    scale = np.where(there, 1 / np.sqrt(np.where(there, values, 1.0)), np.nan)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    return {"n": m.n, "sums": m.sums(), "mean": m.mean, "project": vectors * scale, "explained": np.maximum(explained, 0.0), "there": there}


def _centred(x: np.ndarray, model: dict) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n, exact before the division, and the sum of (n*x - S)**2."""
    n, sums = model["n"], model["sums"]
    room = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if room < 2**62:
        far = x * n - np.array(sums, np.int64)
        if (far.astype(float) ** 2).sum(axis=1).max(initial=0.0) < 2.0**62:
            return far / n, (far * far).sum(axis=1).tolist()
    wide = x.astype(object) * n - np.array(sums, object)
    squares = [int(s) for s in (wide * wide).sum(axis=1)]
    return (wide / n).astype(float), [s if s < 2**63 else None for s in squares]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, fan: int = 16) -> DataFrame:
    """One row per usable vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = written(rows.select("v").mapInArrow(_quantised, "code binary").distinct(), "whitening-fit", small=True)
    models = {d: _model(m, most) for d, m in moments(fit, lambda b: ((q + BASE, True) for q in _unpack(b.column(0))), fan).items()}
    sent = spark.sparkContext.broadcast(models)  # a mean and `most` vectors for each length

    def scores(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bool]]:
        for q in _unpack(b.column(0)):
            model = sent.value[q.shape[1]]
            keep = model["project"][:, model["there"]]
            if keep.shape[1]:
                y = np.zeros((len(q), q.shape[1]))  # as wide as the vectors: lengths stay apart
                y[:, : keep.shape[1]] = _centred(q + BASE, model)[0] @ keep
                yield y, False

    errors = {d: float(np.abs(m.moment / m.n - np.diag((np.arange(d) < models[d]["there"].sum()).astype(float))).max()) for d, m in moments(fit, scores, fan).items()}
    sent_errors = spark.sparkContext.broadcast(errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in _rows(b.column(1)):
                if not len(m):
                    continue
                model = sent.value[m.shape[1]]
                centred, squares = _centred(_quantise(m) + BASE, model)
                y = centred @ np.nan_to_num(model["project"])
                y[:, ~model["there"]] = np.nan
                k = y.shape[1]
                flat = y.ravel()
                columns = [
                    b.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(len(flat), model["n"], np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(m)), k))),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(model["explained"], len(m))),
                    pa.array(np.full(len(flat), sent_errors.value.get(m.shape[1], 0.0))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return done.withColumnRenamed("id", id_col)
