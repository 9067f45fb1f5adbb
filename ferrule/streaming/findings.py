"""Findings that arrive as files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.reports import read_reports


def report_stream(spark: SparkSession, folder: str, kind: str = "sarif") -> DataFrame:
    """Raw results of reports that are put into a folder; each file is read once, and a restart goes on from the query's checkpoint."""
    docs = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(folder)
    return read_reports(docs.select(F.lit(0).cast("long").alias("doc"), F.col("_metadata.file_path").alias("path"), F.lit(kind).alias("kind"), F.col("value").alias("content")))


def first_seen(raw: DataFrame, seen_at: str, keep: str = "7 days") -> DataFrame:
    """Results whose place and rule weren't seen before; the state forgets what is older than `keep`."""
    keyed = raw.select("*", F.col("sink.uri").alias("_uri"), F.col("sink.line").alias("_line")).withWatermark(seen_at, keep)
    return keyed.dropDuplicatesWithinWatermark(["rule_id", "_uri", "_line"]).drop("_uri", "_line")
