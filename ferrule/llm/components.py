"""Connected components by alternating large-star and small-star steps, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import discard, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v long, any order. Returns node, root (the smallest node it reaches) for every node that isn't a root itself.

    Each round rewrites the edges so that nodes point at smaller ones, until every node points at its root; the number of rounds grows with
    the logarithm of the longest chain. Edges are written in the shared folder each round. A hub's edges meet its minimum in a sort-merge
    join that Spark may split where it is skewed, and minima are summed before they are shuffled, so no task holds a group.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        before, e = e, both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(e, "edges")
        discard(before)
        low, before = e.groupBy("u").agg(F.min("v").alias("m")), e
        e = e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(e, "edges")
        discard(before)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
