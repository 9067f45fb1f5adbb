"""Exact top-k by inner product over multi-resolution segment statistics.

A vector is cut into 1, 4, 16 and 32 segments (as far as it has components); of each segment the mean and the deviation are kept. With n
values, means a and b and deviations s and t (root of the summed squares about the mean), a segment's squared distance is at least
n (a - b)^2 + (s - t)^2, so its inner product is at most n a b + s t. Summed over segments, and with the vectors' norms known, a lower bound
of the distance and an upper bound of the inner product are the same statement; the second is used.

Two passes over the tiles of vectors.py. The first gives each query a threshold: in each block the rows of the highest products of finest means
are scored exactly, and the k-th best of all blocks is a lower bound of the k-th best of all rows. The second goes coarse to fine: at each
level rows whose bound is below the query's threshold go, and those that survive all levels are scored exactly.

Components are floor(1024 x), as integers. Where products of a row and a query can't reach 2^53, bounds and scores are computed in doubles:
scores are then exact, and bounds are widened by a part in 10^9 of the product of the two norms. Larger ones are not pruned and are scored in
integers of any size; a score beyond 64 bits becomes the nearest that a long holds, and such scores tie. See vectors.py for the other defined
cases; zero vectors take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import table, written
from ferrule.llm.vectors import best, clean, matrix, ranked, search

LEVELS = (1, 4, 16, 32)
#: Between norms, for the rounding of bounds.
SLACK = 1e-9


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means, then deviations, of each row's segments: the bound is the product of two such rows."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    means = np.stack([x[:, p].mean(axis=1) for p in parts], axis=1)
    devs = np.stack([np.sqrt(((x[:, p] - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means.T)], axis=1)
    return np.concatenate([means * np.sqrt([len(p) for p in parts]), devs], axis=1)


def whole(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """floor(scale x) as doubles, zero in rows that are too large; which are, and their integers."""
    with np.errstate(over="ignore"):
        f = np.floor(scale * x)
    limit = np.sqrt(2.0**53 / x.shape[1])
    large = ~(np.abs(f).max(axis=1) <= limit)
    # From 2^43 on a double is an integer times 1024 or more, so this is the floor.
    exact = {int(i): [int(np.floor(scale * v)) if abs(v) < 2.0**43 else int(v) * scale for v in x[i].tolist()] for i in np.flatnonzero(large)}
    f[large] = 0
    return f, large, exact


def saturated(n: int) -> int:
    return max(-(2**63), min(2**63 - 1, n))


class Block:
    """A tile's rows or queries: integers as doubles, statistics of all levels, norms."""

    def __init__(self, x: np.ndarray, scale: int):
        self.x, self.large, self.exact = whole(x, scale)
        self.levels = [statistics(self.x, s) for s in LEVELS]
        self.norm = np.sqrt((self.x**2).sum(axis=1))

    def ints(self, i: int) -> list[int]:
        return self.exact.get(i) or [int(v) for v in self.x[i].tolist()]


def survivors(rows: Block, queries: Block, i: int, floor: float, at: np.ndarray) -> Iterator[np.ndarray]:
    """Of rows `at` those that are left after each level."""
    slack = SLACK * rows.norm * queries.norm[i] + 1e-6
    for stats, asked in zip(rows.levels, queries.levels):
        part = stats if len(at) == len(stats) else stats[at]
        at = at[part @ asked[i] + slack[at] >= floor]
        yield at


def scored(rows: Block, queries: Block, i: int, at: np.ndarray) -> np.ndarray:
    """Exact scores (long) of rows `at`."""
    if queries.large[i]:
        q = queries.ints(i)
        return np.array([saturated(sum(a * b for a, b in zip(q, rows.ints(int(j))))) for j in at], np.int64)
    out = ((rows.x if len(at) == len(rows.x) else rows.x[at]) @ queries.x[i]).astype(np.int64)
    for k in np.flatnonzero(rows.large[at]):
        out[k] = saturated(sum(a * b for a, b in zip(queries.ints(i), rows.ints(int(at[k])))))
    return out


def first_block(ids: np.ndarray, rows: Block, qids: np.ndarray, queries: Block, k: int):
    """Exact scores of the rows whose finest means promise most."""
    s = rows.levels[-1].shape[1] // 2
    means = rows.levels[-1][:, :s]
    for i, own in enumerate(qids):
        promise = means @ queries.levels[-1][i, :s]
        promise[ids == own] = -np.inf
        n = min(4 * k, len(ids))
        at = np.argpartition(-promise, n - 1)[:n]
        at = at[ids[at] != own]
        scores = scored(rows, queries, i, at)
        top = best(scores, ids[at], k)
        yield own, ids[at[top]], scores[top]


def search_block(ids: np.ndarray, rows: Block, qids: np.ndarray, queries: Block, floors: np.ndarray, k: int):
    every = np.arange(len(ids))
    for i, own in enumerate(qids):
        if queries.large[i]:
            at = every
        else:
            for at in survivors(rows, queries, i, floors[i], every):
                pass
            if rows.exact:
                at = np.union1d(at, np.flatnonzero(rows.large))
        at = at[ids[at] != own]
        scores = scored(rows, queries, i, at)
        good = scores >= floors[i]
        at, scores = at[good], scores[good]
        top = best(scores, ids[at], k)
        yield own, ids[at[top]], scores[top]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row whose vec_id is divisible by `every`, the k highest inner products with other rows."""
    rows = clean(vectors, zero=True)
    queries = rows.where(F.col("vec_id") % every == 0)
    parts = lambda t: (t.column("vec_id").to_numpy(), Block(matrix(t.column("embedding")), scale))

    def first(block, asked):
        yield from first_block(*parts(block), *parts(asked), k)

    def second(block, asked):
        # A query of fewer than k scores has no threshold.
        floors = asked.column("floor").to_numpy(zero_copy_only=False).astype(float)
        yield from search_block(*parts(block), *parts(asked), np.where(np.isnan(floors), -np.inf, floors), k)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = search(rows, queries, first, block_rows, "long").withColumn("nth", F.row_number().over(w)).where(F.col("nth") == k)
    # Rounded down to a double: a threshold may be lower than it needs to be.
    kth = kth.select(F.col("query_id").alias("vec_id"), (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("floor"))
    asked = written(queries.join(kth, "vec_id", "left"), "asked")
    return ranked(search(rows, asked, second, block_rows, "long"), k)


def op10_segment_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
