"""What the two vector searches share: clean vectors, tiles of rows and queries, and the merge of the tiles' answers.

Rows are dealt to blocks of about `block_rows` by a hash of their id, queries to as many blocks as they fill; a task holds one tile, a block of
rows and a block of queries, whatever the table's size, and answers with its own best k for each of its queries. The best of these are the
answer. Queries are rows of the table themselves, so an answer without loss takes queries times rows where vectors have no structure; it is
spread over the tiles, and each row is copied once for each block of queries.

Defined for both: vec_id is a key; of repeated rows of a vec_id the least vector counts; rows with a null vec_id take no part; a query meets
only candidates of its own number of components; ties go to the smaller vec_id. An empty table gives an empty result. Only vec_id and embedding
are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import written


def clean(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, embedding (array of double); zero: whether zero vectors take part."""
    x = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad))
    if not zero:
        v = v.where(F.exists(x, lambda y: y != 0))
    return written(v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")


def sampled(rows: DataFrame, size: int) -> DataFrame:
    """About `size` rows, chosen by the hash of their ids alone; all of a table that has no more."""
    n = rows.count()
    return rows if n <= size else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < (1 << 40) * size // n)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(rows: DataFrame, queries: DataFrame, answer: Callable, block_rows: int, score: str) -> DataFrame:
    """rows: vec_id, embedding. queries: the same, and what else the answer needs. answer(block, queries) yields (query_id, vec_ids, scores), both given as Arrow tables.

    Returns query_id, vec_id, score of what the tiles answer.
    """
    blocks, parts = (max(1, -(-x.count() // block_rows)) for x in (rows, queries))  # of tables that are written
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dims = F.size("embedding").alias("dims")
    more = [c for c in queries.columns if c not in rows.columns]
    own = rows.select("*", *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in more], dims, deal(blocks).alias("block"), copies(parts).alias("part"), F.lit(False).alias("asks"))
    asked = queries.select(*rows.columns, *more, dims, copies(blocks).alias("block"), deal(parts).alias("part"), F.lit(True).alias("asks"))
    number = pa.float64() if score == "double" else pa.int64()

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        q, ids, s = [], [], []
        if asks.any() and not asks.all():
            for query, found, scores in answer(table.filter(pa.array(~asks)), table.filter(pa.array(asks))):
                q.append(np.full(len(found), query))
                ids.append(found)
                s.append(scores)
        cat = lambda x: np.concatenate(x) if x else np.array([], np.int64)
        return pa.table({"query_id": pa.array(cat(q), pa.int64()), "vec_id": pa.array(cat(ids), pa.int64()), "score": pa.array(cat(s), number)})

    return own.union(asked).groupBy("dims", "block", "part").applyInArrow(run, f"query_id long, vec_id long, score {score}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
