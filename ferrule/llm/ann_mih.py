"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred and turned by rotations that are learned on a bounded sample so that signs lose little (iterative quantisation);
each rotation gives a bit per component. Rotations from different starts are joined until a code has at least `bits` bits.

Index: a code is cut into substrings of one byte, and each substring is an index of its own: for each of its 256 values the rows that have it,
as offsets into one list (Index). A code within Hamming distance r of a query's differs from it by at most r_j in some substring j, where the
r_j + 1 add up to r + 1. So of each index the buckets within r_j are probed, ring by ring; what they list is verified by the Hamming distance
of the whole codes, and what lies within r is ranked by the inner product of the original vectors, in double precision. Distances and products
are computed for listed rows alone.

The radius is learned with the rotations: the distance within which a share `recall` of the true neighbours of the sample's vectors lie, in the
sample. Of a larger table the neighbours are nearer, so it errs on the safe side. A query that finds fewer than k rows within it goes on with
wider rings until every block has given it k or all its rows. How much the index saves depends on the vectors: where they lie in groups, the
buckets list few rows; where they have no structure, true neighbours lie at two fifths of the bits and the buckets list nearly all.

Every row is indexed; only rotations and radius are fitted on the sample, about `sample` rows chosen by the hashes of their ids. Inner products
that overflow are infinite; one that is no number ranks as minus infinity. Vectors with components beyond 1e100 are scaled down for their codes.
See vectors.py for the other defined cases; zero vectors take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import table, written
from ferrule.llm.vectors import best, clean, matrix, ranked, sampled, search

VALUES = np.arange(256, dtype=np.uint8)
#: RINGS[d]: what differs in d bits of a byte.
RINGS = [VALUES[np.bitwise_count(VALUES) == d].astype(np.int64) for d in range(9)]


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 15) -> np.ndarray:
    """The rotation whose signs are nearest to the turned vectors, from a random start."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ vt).T
    return r


def tame(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    return x / np.where(top > 1e100, top, 1.0)


def products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row in one order of addition: equal vectors have equal products."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (x * v).sum(axis=1)
    return np.where(np.isnan(s), -np.inf, s)


class Codes:
    """The learned code: centre, rotations, and the radius within which the neighbours lie."""

    def __init__(self, sample: np.ndarray, bits: int, k: int, recall: float, asked: int = 256):
        x = tame(sample)
        self.mean = x.mean(axis=0)
        d = x.shape[1]
        x = x - self.mean
        self.rotation = np.concatenate([learn_rotation(x, s) for s in range(-(-bits // d))], axis=1)
        self.rotation = self.rotation[:, : max(8, self.rotation.shape[1] // 8 * 8)]
        codes = self.encode(sample)
        far = []
        for i in range(0, len(sample), max(1, len(sample) // asked)):
            s = products(sample, sample[i])
            s[i] = -np.inf
            near = np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)]
            far.append(distances(codes[i], codes[near]))
        far = np.concatenate(far)
        self.radius = int(np.ceil(np.quantile(far, recall))) if len(far) else 0

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes each; codes of fewer bytes than 8 times some number are filled with zeros."""
        c = np.packbits((tame(x) - self.mean) @ self.rotation > 0, axis=1)
        return np.ascontiguousarray(np.pad(c, ((0, 0), (0, -c.shape[1] % 8))))


def distances(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hamming distances of a code to codes, all of the same number of bytes, eight times some number."""
    return np.bitwise_count(code.view(np.uint64) ^ codes.view(np.uint64)).sum(axis=1, dtype=np.int64)


class Index:
    """For each substring and value the rows that have it: rows[starts[256 j + v]:starts[256 j + v + 1]]."""

    def __init__(self, codes: np.ndarray):
        self.codes, (n, self.m) = codes, codes.shape
        self.rows = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32).ravel()
        counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(self.m)])
        self.starts = np.concatenate(([0], np.cumsum(counts.ravel())))

    def probe(self, code: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The rows that the buckets list, with repetitions."""
        a, n = self.starts[buckets], self.starts[buckets + 1] - self.starts[buckets]
        end = np.cumsum(n)
        return self.rows[np.arange(end[-1] if len(end) else 0) + np.repeat(a - end + n, n)]

    def within(self, code: np.ndarray, radius: int, listed: np.ndarray | None = None, known: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of all listed rows, among them all within the radius. listed: rows that are marked as listed already, up to radius `known`."""
        listed = np.zeros(len(self.codes), bool) if listed is None else listed
        own = code.astype(np.int64)
        # Radius r: substring j is probed up to (r + 1) // m - 1, the first (r + 1) % m of them one ring further. From the known radius on, rings are new.
        ring = lambda r, j: (r + 1) // self.m - 1 + (j < (r + 1) % self.m)
        todo = [256 * j + (own[j] ^ RINGS[d]) for j in range(self.m) for d in range(ring(known, j) + 1, min(8, ring(radius, j)) + 1)]
        if todo:
            listed[self.probe(code, np.concatenate(todo))] = True
        rows = np.flatnonzero(listed)
        return rows, distances(code, self.codes[rows])


def search_block(model: Codes, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, qx: np.ndarray, k: int, fill: bool):
    """fill: go on beyond the learned radius until k rows or all are found."""
    index, codes = Index(model.encode(x)), model.encode(qx)
    bits = codes.shape[1] * 8
    place = {int(v): i for i, v in enumerate(ids)}
    for own, code, v in zip(qids, codes, qx):
        listed, known, r = np.zeros(len(ids), bool), -1, model.radius
        mine = place.get(int(own))
        while True:
            rows, far = index.within(code, r, listed, known)
            rows = rows[(far <= r) & (ids[rows] != own)] if mine is not None else rows[far <= r]
            if not fill or len(rows) >= k or r >= bits:
                break
            known, r = r, min(bits, r + max(1, index.m // 4))
        s = products(x[rows], v)
        top = best(s, ids[rows], k)
        yield own, ids[rows[top]], s[top]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, bits: int = 256, recall: float = 0.97, sample: int = 8192, block_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest found by inner product."""
    rows = clean(vectors, zero=False)
    queries = rows.where(F.col("vec_id") % every == 0)
    # Bounded: about `sample` rows come to the driver, of each number of components in proportion.
    some = sampled(rows, sample).orderBy("vec_id").toPandas()["embedding"]
    models = {}
    for d in {len(v) for v in some}:
        models[d] = Codes(np.array([v for v in some if len(v) == d], float), bits, k, recall)

    def answers(fill: bool):
        def answer(block, queries):
            x, qx = matrix(block.column("embedding")), matrix(queries.column("embedding"))
            model = models.get(x.shape[1]) or Codes(x[np.argsort(block.column("vec_id").to_numpy())][:sample], bits, k, recall)
            yield from search_block(model, block.column("vec_id").to_numpy(), x, queries.column("vec_id").to_numpy(), qx, k, fill)

        return answer

    found = written(search(rows, queries, answers(False), block_rows, "double"), "found")
    # Queries that found fewer than k within the radius ask again, as far as it takes.
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(queries.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        again = search(rows, short, answers(True), block_rows, "double")
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(again)
    return ranked(found, k)


def op1_mih_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
