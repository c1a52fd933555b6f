"""Whitened embeddings: coordinates along the covariance's eigenvectors, each scaled to variance one.

Entries c become whole numbers x = floor(64 c) + 1000000. The covariance is over the distinct x vectors, which Spark finds, sums up and, centred,
multiplies in tasks; one d x d matrix reaches the driver, whatever the number of rows. There, float32 eigenvectors are corrected by
Ogita-Aishima iterations, matrix products in extended precision that converge quadratically. Where eigenvalues lie too close to be
told apart at the present accuracy, the block of such a cluster is solved anew within its own subspace, shifted by its mean, so that its
small differences count at full precision; then the iteration goes on.

Rows whose vector is null or holds a null, NaN or infinite entry are dropped, as are empty vectors and vectors of another than the
commonest length (of equally common lengths the larger counts). Entries beyond 2^33 count as 2^33. Repeated vectors and ids stay rows
of the result, though a vector counts once in the covariance. A component whose eigenvalue is zero (to working precision) has null as
`whitened`; explained is null where all vectors are equal. `deviation` is null beyond 64 bits. Of a multiple eigenvalue any basis of its
space serves, the same for all rows. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import store

STEP, SHIFT, LARGEST = 64, 1_000_000, float(1 << 33)
COMPONENTS = 16
#: Rounds of correction at most; three are usual.
ROUNDS = 12
_WIDE = np.longdouble


def correct(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of symmetric a to double precision, falling, from approximate eigenvectors x."""
    a, x = a.astype(_WIDE), x.astype(_WIDE)
    size, one = np.sqrt((a * a).sum()), np.eye(len(a), dtype=_WIDE)
    enough = np.finfo(np.float64).eps / 16
    # Rounding alone moves eigenvalues so far.
    floor = 64 * len(a) * size * np.finfo(_WIDE).eps
    values = np.diag(x.T @ a @ x)
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        # Two eigenvalues within this distance can't be told apart by the present vectors.
        near = max(2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())), floor)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        step = np.abs(e).max(initial=0)
        x = x + x @ e
        clusters = [c for c in _clusters(values, near) if len(c) > 1]
        for own in clusters:
            x[:, own] = _solve_within(a, x[:, own])
        if step < enough and (not clusters or near <= max(size * enough * len(a), floor)):
            break
    for _ in range(4):
        # Where a cluster isn't told apart, rounding may have left its vectors at an angle.
        x = x @ (1.5 * one - x.T @ x / 2)
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), (x / np.sqrt((x * x).sum(axis=0)))[:, order].astype(np.float64)


def _clusters(values: np.ndarray, near: np.floating) -> list[np.ndarray]:
    """Places of eigenvalues by runs whose neighbours are no further apart than near."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order]) > near) + 1)


def _solve_within(a: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The columns of own, turned within their space to the eigenvectors of a's block there; the block is shifted by its mean and scaled,
    so that double precision suffices for differences however small beside a."""
    gram = own.T @ own
    own = own @ (1.5 * np.eye(own.shape[1], dtype=_WIDE) - gram / 2)
    mean = np.trace(own.T @ a @ own) / own.shape[1]
    block = own.T @ (a @ own - mean * own)
    scale = np.abs(block).max()
    if scale == 0:
        return own
    _, turn = np.linalg.eigh(((block + block.T) / (2 * scale)).astype(np.float64))
    turn = turn.astype(_WIDE)
    return own @ (turn @ (1.5 * np.eye(len(turn), dtype=_WIDE) - turn.T @ turn / 2))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, falling: solved in float32, then corrected."""
    scale = np.abs(v).max(initial=0)
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    _, x = np.linalg.eigh((v / scale).astype(np.float32))
    values, x = correct(v / scale, x)
    return values * scale, x


@dataclass
class Fit:
    """n distinct vectors, their exact sums, eigenvalues and eigenvectors of their covariance, its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n of integer vectors: exact differences to the whole part of the mean, then its fraction."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """Of the first k components; nan where the eigenvalue is zero."""
        e = self.values[:k]
        scale = np.where(e > self.trace * len(self.sums) * np.finfo(np.float64).eps, e, np.nan)
        return self.centred(x) @ self.vectors[:, :k] / np.sqrt(scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2, in whole numbers."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(y).max(initial=0)) ** 2 * len(self.sums) < 1 << 63:
                return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows that count."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    wide = rows.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", fine))
    bound = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    whole = wide.select("vec_id", F.transform("c", lambda c: F.floor(bound(c) * STEP) + SHIFT).alias("x"))
    length = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).agg(F.max_by("d", F.struct("rows", "d"))).first()[0]
    return whole.where(F.size("x") == length)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _gram(rows: DataFrame, make: object, d: int) -> np.ndarray:
    """Sum over rows of make(x)'s outer products: a task sums its own, Spark sums the tasks' entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = make(_matrix(batch))
                total += y.T @ y
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    found = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


def fit(distinct: DataFrame) -> Fit | None:
    """The fit of distinct x vectors; None without rows."""
    sums = distinct.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("k").collect()
    if not sums:
        return None
    d, n = len(sums), sums[0].n
    got = Fit(n, [int(r.s) for r in sums], np.zeros(d), np.eye(d), 0.0)
    v = _gram(distinct, got.centred, d) / n
    got.values, got.vectors = eigen(v)
    got.values, got.trace = np.maximum(got.values, 0), float(np.trace(v))
    return got


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row that counts."""
    store.small_batches(embeddings.sparkSession)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = store.materialise(whole_vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "whole-vectors")
    distinct = store.materialise(whole.select("x").distinct(), "distinct-vectors")
    found = fit(distinct)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    k = min(components, len(found.sums))
    own = _gram(distinct, lambda x: np.nan_to_num(found.whitened(x, k)), k) / found.n
    real = np.flatnonzero(found.values[:k] > found.trace * len(found.sums) * np.finfo(np.float64).eps)
    error = float(np.abs(own[np.ix_(real, real)] - np.eye(len(real))).max(initial=0.0))
    explained = [float(e / found.trace) if found.trace else None for e in found.values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ids, n = _matrix(batch), batch.column(batch.schema.get_field_index("vec_id")), batch.num_rows
                rows = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, found.n)),
                    pa.array(found.deviations(x), pa.int64()).take(pa.array(rows)), pa.array(found.whitened(x, k).ravel(), from_pandas=True),
                    pa.array(explained * n, pa.float64()), pa.array(np.full(n * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(run, schema)
