"""Whitening of embeddings by block Lanczos without a covariance matrix.

Entries become integers x = floor(64 c) + 1000000, so sums per dimension and deviations are exact. The covariance V is never formed: a pass over the rows gives
V Q for a block Q of vectors, from rows that are centred first, added within a task by numpy and across tasks by Spark. The driver holds the basis
alone, dimensions times basis vectors, whatever the number of rows.

Each new block is made orthogonal to the whole basis, twice. A direction that vanishes there (a breakdown: the basis spans an invariant space) starts again from
a random one. A pair has converged when its residual |V u - e u| is within `tol` of the largest eigenvalue; when the first k have, either the trace
(from the deviations) leaves too little for any other eigenvalue to come before them, or a random block is added and the same pairs must
come out again. A basis as large as the number of dimensions is exact in any case.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take no part; all others do, repeated rows and rows with a null vec_id
each for itself. 64 c counts as 2^53 at most (and -2^53 at least). Vectors of each length are a fit list of their own. A deviation beyond a long
is null. Components whose eigenvalue is nil (within rounding of the largest) are no components, so equal vectors have none and give no rows, like an
empty table. Eigenvectors of equal eigenvalues are any orthonormal ones. The largest entry of a component (the first of these) is positive.
Only vec_id and embedding are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import table, written
from ferrule.llm.vectors import matrix

SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 53)
#: Sums are taken of the high and the low part of an integer, each of which fits whatever the number of rows.
LOW = 26


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long), of the rows that take part."""
    c = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fit = lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(OFFSET).cast("long")
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, bad))
    return v.select("vec_id", F.transform(c, fit).alias("x"))


def added(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """work(block of rows) gives a list of numbers; their sums over all rows. The list's length must not depend on the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = work(matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    number = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    got = rows.select("x").mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum(number).alias("v")).collect()
    return np.array([int(r.v) if kind == "long" else r.v for r in sorted(got, key=lambda r: r.i)], object if kind == "long" else float)


@dataclass
class Centre:
    """x - S / n. n x - S is exact where it fits a long, and then rounded once."""

    n: int
    sums: list[int]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.n * int(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, self.sums)) < 1 << 61:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def deviation(self, rows: DataFrame) -> DataFrame:
        """rows with deviation: the sum of (n x - S)^2, null if a long can't hold it; and spread, the sum of (x - S / n)^2."""
        fits = max(map(abs, self.sums)) < 1 << 63
        sums = F.array(*[F.lit(s if fits else 0).cast("long") for s in self.sums])
        exact = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(F.lit(self.n).cast("long"), x), s))
        square = F.aggregate(exact, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
        means = F.array(*[F.lit(s / self.n) for s in self.sums])
        spread = F.aggregate(F.zip_with("x", means, lambda x, m: x - m), F.lit(0.0), lambda a, d: a + d * d)
        return rows.select("*", (square if fits else F.lit(None).cast("long")).alias("deviation"), spread.alias("spread"))


def fitted(rows: DataFrame, n: int) -> Centre:
    """rows: n rows of x, all of one length."""
    halves = added(rows, lambda x: np.concatenate(((x >> LOW).sum(axis=0), (x & ((1 << LOW) - 1)).sum(axis=0))), "long")
    high, low = np.split(halves, 2)
    return Centre(n, [int(h) * (1 << LOW) + int(w) for h, w in zip(high, low)])


def orthonormal(block: np.ndarray, basis: np.ndarray, nil: float, r: np.random.Generator) -> tuple[np.ndarray, int]:
    """The block's columns made orthonormal, also to the basis, in full and twice; and how many vanished (at most `nil` long) and were started anew at random."""
    out, anew = basis, 0
    for v in block.T:
        while True:
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > nil:
                break
            anew += 1
            v, nil = r.normal(size=len(v)), 1e-9
        v = v / size
        v = v - out @ (out.T @ v)
        out = np.column_stack((out, v / np.linalg.norm(v)))
    return out[:, basis.shape[1] :], anew


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, trace: float, block: int = 8, tol: float = 1e-13, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues, given as Q -> matrix Q."""
    r, k = np.random.default_rng(seed), min(k, d)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    after, known, top = r.normal(size=(d, block)), None, 0.0
    while True:
        new, _ = orthonormal(after[:, : min(block, d - basis.shape[1])], basis, 1e-12 * top, r)
        got = apply(new)
        basis, images = np.column_stack((basis, new)), np.column_stack((images, got))
        t = basis.T @ images
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        top, after = max(0.0, e[0]), got
        enough = basis.shape[1] >= k and bool((np.linalg.norm(images @ s[:, :k] - basis @ (s[:, :k] * e[:k]), axis=0) <= tol * top).all())
        if basis.shape[1] == d or enough and (trace - e.sum() <= e[k - 1] or known is not None and np.allclose(known, e[:k], rtol=1e-9, atol=tol * top)):
            vectors = basis @ s[:, :k]
            vectors /= np.linalg.norm(vectors, axis=0)
            return e[:k], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
        if enough:
            known, after = e[:k].copy(), r.normal(size=(d, block))


@dataclass
class Whitening:
    """What a fit has learned: components (columns), their eigenvalues, their shares of the trace, and how far the whitened covariance is from the identity."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, n: int, k: int = 32, block: int = 8) -> tuple[Whitening, DataFrame]:
    """rows: vec_id, x, written, n rows of one length. Returns what was learned, and rows with their deviations."""
    centre = fitted(rows, n)
    rows, d = centre.deviation(rows), len(centre.sums)
    whole, rest = rows.agg(F.sum(F.col("deviation").cast("decimal(38,0)")), F.sum(F.when(F.col("deviation").isNull(), F.col("spread")))).first()
    trace = int(whole or 0) / n**3 + (rest or 0.0) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return (c.T @ (c @ q)).ravel()

        return added(rows, work).reshape(q.shape) / n

    values, vectors = block_lanczos(apply, d, k, trace, block)
    there = values > 8 * d * np.finfo(float).eps * max(0.0, values[0])
    values, vectors = values[there], vectors[:, there]
    out = Whitening(centre, vectors, values, values / trace if trace > 0 else values)
    if k := len(values):

        def moments(x: np.ndarray) -> np.ndarray:
            w = out.project(x)  # centred already: the mean that is left is rounding
            return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

        sums = added(rows, moments)
        mean = sums[:k] / n
        out.identity_error = float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return out, rows


def whiten(vectors: DataFrame, k: int = 32, block: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each of its components."""
    every = written(integers(vectors), "whitening")
    out = None
    for d, n in sorted(every.groupBy(F.size("x")).count().collect()):
        model, rows = fit(every.where(F.size("x") == d), n, k, block)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = model.project(matrix(b.column(2))) if b.num_rows else np.zeros((0, len(model.values)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "deviation", "w"])

        done = rows.select("vec_id", "deviation", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
        shares = F.array(*[F.lit(float(s)) for s in model.shares]) if len(model.shares) else F.array().cast("array<double>")
        done = done.select(
            "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
        )
        out = done if out is None else out.union(done)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out


def op11_lanczos_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
