"""Whitening of embeddings by an incremental eigendecomposition.

A vector's entries become the integers x = floor(64 * c) + 1000000. The sums S of all n vectors are exact. Each partition then
keeps a spectrum (eigenvalues and eigenvectors of its scatter matrix) and takes its centred vectors in one at a time: a
rank-one update rotates the vector into the eigenbasis, deflates what does not change, solves the secular equation for the new
eigenvalues and turns the basis. Spectra of partitions are combined eight at a time by further rank-one updates, one for each
scaled eigenvector, level by level in the cluster. A last pass projects all vectors on the combined basis and adds up their
products (Rayleigh-Ritz); its small eigenproblem gives the components to double precision. Equal vectors of a batch are one
update with a weight. A task holds matrices of dimension x dimension only; what reaches the driver is one such matrix, so the
bound of all broadcasts is the square of the dimension.

Edges: rows whose vector is null or holds null or non-finite entries are dropped. All vectors need one length; those of another
than the most frequent length (of equals the longest) are dropped too. A null vec_id and repeated rows stay, each counts. An
empty table gives an empty result. A component without variance (at most 1e-12 of the trace: fewer vectors than dimensions,
constant entries) has whitened null, is left out of identity_error and counts as explained 0 or its tiny share. A deviation
beyond 64 bits is null. Only the id and the vector column are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Spectra that one task combines, and the share of the trace below which a component counts as constant.
FAN_IN, FLAT = 8, 1e-12
_EPS = float(np.finfo(float).eps)


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum z_j^2 / (d_j - root) = 0 for ascending, distinct d: (roots, d_j - root_i as [i, j]).

    Each root is sought as a distance from its nearer pole, so that the differences keep their relative precision. A step
    interpolates the two sums left and right of the root by one pole each and is replaced by halving when it leaves the bracket.
    """
    k, w = len(d), rho * z * z
    if k == 1:
        return d + w, -w[None, :]
    i = np.arange(k)
    gap = np.append(np.diff(d), w.sum())
    middle = 1 + (w / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    near_left = (middle > 0) | (i == k - 1)
    pole = np.where(near_left, i, i + 1)
    away = d[None, :] - d[pole][:, None]
    low = np.where(near_left, 0.0, -gap / 2)
    high = np.where(near_left, gap / 2, 0.0)
    high[-1] = gap[-1]
    if middle[-1] > 0:
        high[-1] = gap[-1] / 2
    else:
        low[-1] = gap[-1] / 2
    mu = (low + high) / 2
    left_of = i[None, :] <= i[:, None]
    settled = np.zeros(k, bool)
    right_pole = np.minimum(i + 1, k - 1)
    for _ in range(80):
        g = away - mu[:, None]
        t = w / g
        f = 1 + t.sum(1)
        settled |= (np.abs(f) <= 4 * _EPS * k * (1 + np.abs(t).sum(1))) | (high - low <= 4 * _EPS * np.abs(mu))
        if settled.all():
            break
        low, high = np.where(f < 0, mu, low), np.where(f > 0, mu, high)
        slope = t / g
        psi = np.where(left_of, slope, 0).sum(1)
        phi = slope.sum(1) - psi
        a, b = g[i, i], g[i, right_pole]
        c = f - a * psi - b * phi
        p, q = (a + b) * f - a * b * (psi + phi), a * b * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            c_last = f[-1] - a[-1] * psi[-1]
            step[-1] = a[-1] + a[-1] * a[-1] * psi[-1] / c_last if c_last > 0 else np.nan
        new = mu + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        settled |= np.abs(step) <= 4 * _EPS * np.abs(mu)
        mu = np.where(settled, mu, np.where(inside, new, (low + high) / 2))
    return d[pole] + mu, away - mu[:, None]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of q diag(d) q' + rho v v'."""
    z = q.T @ v
    size = float(np.sqrt(z @ z))
    if not size:
        return d, q
    z, rho = z / size, rho * size * size
    tol = 8 * _EPS * max(float(np.abs(d).max()), rho)
    close = np.diff(d) <= tol
    if close.any():  # equal eigenvalues: turn their eigenvectors so that one of them takes all of z
        q = q.copy()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], close.view(np.int8), [0]))))
        for a, b in edges.reshape(-1, 2):
            part = z[a : b + 1].copy()
            length = float(np.sqrt(part @ part))
            if length * rho > tol:
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                mirror /= np.sqrt(mirror @ mirror)
                q[:, a : b + 1] -= 2 * np.outer(q[:, a : b + 1] @ mirror, mirror)
                z[a : b + 1] = 0
                z[b] = -np.copysign(length, part[-1])
    live = np.flatnonzero(np.abs(z) * rho > tol)
    if not len(live):
        return d, q
    dl, zl = d[live], z[live]
    new, away = secular_roots(dl, zl, rho)
    if len(live) > 1:
        # z that fits the found roots exactly (Gu and Eisenstat), so that the eigenvectors are orthogonal
        between = dl[:, None] - dl[None, :]  # [j, i]
        np.fill_diagonal(between, 1.0)
        fitted = np.sqrt(np.abs(np.prod(-away.T / np.where(np.eye(len(live), dtype=bool), 1.0, -between), axis=1)))
        turn = (np.copysign(fitted, zl)[None, :] / away).T
        turn /= np.sqrt((turn * turn).sum(0))
        q = q.copy()
        q[:, live] = q[:, live] @ turn
    d = d.copy()
    d[live] = new
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as integers x."""
    return quantised(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims))


def quantised(c: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * c)
    if np.abs(x).max(initial=0) < 2**62:
        return x.astype(np.int64) + OFFSET
    whole = np.empty(x.shape, object)
    whole.ravel()[:] = [int(v) + OFFSET for v in x.ravel()]
    return whole


@dataclass(frozen=True)
class Centre:
    """n vectors of known integer sums."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles: the whole part of S / n is taken off in integers first."""
        whole = np.array([s // self.n for s in self.sums], object if x.dtype == object else np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2, by 64-bit integers where they suffice."""
        if x.dtype != object:
            far = float(np.abs(self.centred(x)).max(initial=0)) * self.n + self.n
            big = max(abs(s) for s in self.sums) + self.n * float(np.abs(x).max(initial=0))
            if far * far * x.shape[1] < 2**62 and big < 2**62:
                y = x * self.n - np.array(self.sums, np.int64)
                return (y * y).sum(1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1)
        return [v if v < 2**63 else None for v in exact]


def _sums(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            small = x.dtype != object and float(np.abs(x).max(initial=0)) * len(x) < 2**62
            total += (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
            n += len(x)
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(int(s)) for s in total], kind)], names=["i", "n", "s"])

    return add


def _spectra(dims: int, centre: Centre):
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        d, q = np.zeros(dims), np.eye(dims)
        for batch in batches:
            x, often = np.unique(centre.centred(_matrix(batch.column(1), dims)), axis=0, return_counts=True)
            for v, rho in zip(x, often.tolist(), strict=True):
                d, q = rank_one(d, q, v, float(rho))
        yield _spectrum(TaskContext.get().partitionId(), d, q)

    return follow


def _spectrum(part: int, d: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    keep = np.flatnonzero(d > 0)
    flat = pa.array(np.ascontiguousarray(q[:, keep].T).ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * len(q), pa.int32()), flat)
    return pa.record_batch([pa.array([part] * len(keep), pa.int64()), pa.array(d[keep]), vectors], names=["part", "d", "q"])


def _combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One spectrum of up to FAN_IN: the first with most rows is the base, the others' scaled eigenvectors are taken in."""
    part, dims = int(key[0]), len(rows["q"].iloc[0])
    rows = rows.sort_values(["part", "d"])
    base = rows["part"].value_counts(sort=False).idxmax()
    own, rest = rows[rows["part"] == base], rows[rows["part"] != base]
    q = np.stack(own["q"].to_list(), axis=1)
    d = own["d"].to_numpy()
    if len(d) < dims:  # complete the basis
        full, _ = np.linalg.qr(np.concatenate([q, np.eye(dims)], axis=1))
        q, d = np.concatenate([full[:, len(d) : dims], q], axis=1), np.concatenate([np.zeros(dims - len(d)), d])
    for value, vector in zip(rest["d"], rest["q"], strict=True):
        d, q = rank_one(d, q, np.asarray(vector), float(value))
    keep = np.flatnonzero(d > 0)
    return pd.DataFrame({"part": part, "d": d[keep], "q": list(q[:, keep].T)})


def _products(dims: int, centre: Centre, basis):
    """Sums of products of the vectors' coordinates in the basis, a row of the upper triangle each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        total, some = np.zeros((b.shape[1], b.shape[1])), False
        for batch in batches:
            y = centre.centred(_matrix(batch.column(1), dims)) @ b
            total += y.T @ y
            some = True
        if some:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    return add


def _summed(vectors: DataFrame, dims: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """The covariance of the vectors' coordinates in the basis."""
    sent = vectors.sparkSession.sparkContext.broadcast(basis)
    rows = vectors.mapInArrow(_products(dims, centre, sent), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((basis.shape[1], basis.shape[1]))
    out[rows["i"], rows["j"]] = out[rows["j"], rows["i"]] = rows["s"]
    return out / centre.n


def _whitened(dims: int, centre: Centre, model, id_type: pa.DataType):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, explained, flat, error = model.value
        k = len(explained)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            rows = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            values = (centre.centred(x) @ axes).ravel()
            none = np.tile(flat, rows)
            deviations = pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            out = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, centre.n)), deviations, pa.array(values, mask=none), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.record_batch(out, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return give


def usable_vectors(table: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the finite vectors of the most frequent length, and that length (0: none)."""
    v = F.col(f"`{vector_column}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = table.select(F.col(f"`{id_column}`").alias("vec_id"), v.alias("v")).filter(v.isNotNull() & ~bad)
    most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else 0
    return rows.filter(F.size("v") == dims), dims


def fit(vectors: DataFrame, dims: int) -> tuple[Centre, np.ndarray, np.ndarray]:
    """The centre, all eigenvalues of the covariance (falling) and their unit eigenvectors (columns)."""
    spark = vectors.sparkSession
    sums = vectors.mapInArrow(_sums(dims), "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    centre = Centre(sums[0]["n"], tuple(int(r["s"]) for r in sums))
    spectra = staged(vectors.mapInArrow(_spectra(dims, centre), "part bigint, d double, q array<double>"), "spectra")
    parts = spectra.agg(F.max("part")).first()[0]
    merged = spectra
    while parts:
        merged = merged.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(_combined, "part bigint, d double, q array<double>")
        parts //= FAN_IN
    rows = merged.toPandas().sort_values("d", ascending=False, kind="stable")
    basis = np.eye(dims)
    if len(rows):
        q = np.stack(rows["q"].to_list(), axis=1)
        basis, _ = np.linalg.qr(np.concatenate([q, np.eye(dims)], axis=1)) if q.shape[1] < dims else np.linalg.qr(q)
    e, turn = np.linalg.eigh(_summed(vectors, dims, centre, basis[:, :dims]))
    unstage(spectra)
    return centre, e[::-1].copy(), basis[:, :dims] @ turn[:, ::-1]


def whiten(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = table.sparkSession
    id_type = table.schema[id_column].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors, dims = usable_vectors(table, id_column, vector_column)
    if not dims:
        return spark.createDataFrame([], schema)
    centre, e, q = fit(vectors, dims)
    k = min(components, dims)
    trace = float(e.clip(0).sum())
    flat = ~(e[:k] > FLAT * trace)
    axes = q[:, :k] / np.sqrt(np.where(flat, 1.0, e[:k]))
    good = np.flatnonzero(~flat)
    error = float(np.abs(_summed(vectors, dims, centre, axes[:, good]) - np.eye(len(good))).max()) if len(good) else 0.0
    model = spark.sparkContext.broadcast((axes, e[:k].clip(0) / trace if trace else np.zeros(k), flat, error))
    return vectors.mapInArrow(_whitened(dims, centre, model, None), schema)
