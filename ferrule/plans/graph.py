"""The entity graph of a project from its own facts: files and functions, what contains what, what calls what, and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.communities import leiden
from ferrule.operators.lowering import facts


def entity_graph(lowered: DataFrame, functions: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, file_type, source_file, source_location) and links (source, target, relation, confidence). functions: those of lowered."""
    f = functions.select("fn", "file", "name", "line")
    files = facts(lowered, "module").select("file").distinct()
    nodes = files.select(F.col("file").alias("id"), F.element_at(F.split("file", "/"), -1).alias("label"), F.lit("code").alias("file_type"), F.col("file").alias("source_file"), F.lit("L1").alias("source_location"))
    nodes = nodes.union(f.select("fn", F.concat("name", F.lit("()")), F.lit("code"), "file", F.concat(F.lit("L"), F.col("line").cast("string"))))
    contains = f.select(F.col("file").alias("source"), F.col("fn").alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    sure = F.when(F.col("provenance") == "oracle", "AMBIGUOUS").when(F.col("kind") == "method", "INFERRED").otherwise("EXTRACTED")
    calls = bound.groupBy(F.col("fn").alias("source"), "target").agg(F.max(sure).alias("confidence")).select("source", "target", F.lit("calls").alias("relation"), "confidence")
    return nodes, contains.union(calls)


def communities(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, community: by links, whatever their direction (see operators/communities.py)."""
    return leiden(nodes, links.select("source", "target"))
