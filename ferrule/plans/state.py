"""Tables that a plan writes between its rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def kept(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder (spark.checkpoint.dir) and read again, so that plans don't grow and lost executors cost nothing.

    Its joins are by sorting, none goes through the driver: Spark would take the size of files for that of rows, and a plan of many rounds has many joins.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = read(spark, df.schema, path)
    out._ferrule_path = path
    return out


def watched(df: DataFrame, what: str, **sums: Column) -> tuple[DataFrame, dict]:
    """kept(), and these aggregates of its rows, which the write itself observes: no job of their own."""
    seen = Observation()
    out = kept(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), what)
    return out, seen.get


def kept_paths(tables: list[DataFrame]) -> DataFrame:
    """Tables of kept() with one schema as one table: a single scan, however many there are."""
    return read(tables[0].sparkSession, tables[0].schema, *[x._ferrule_path for x in tables])


def read(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    """Tables of kept()."""
    return spark.read.schema(schema).parquet(*paths).hint("merge")


def discard(*tables: DataFrame) -> None:
    """Removes tables of kept(); only once what was made of them is written itself."""
    for x in tables:
        path = x.sparkSession._jvm.org.apache.hadoop.fs.Path(x._ferrule_path)
        path.getFileSystem(x.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def exists(table: DataFrame) -> bool:
    """Whether a table of kept() is still there."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._ferrule_path)
    return path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).exists(path)


def folder(spark: SparkSession) -> str:
    """What this application writes lies here."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        # Only a local session's tasks see a folder of this machine.
        if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/ferrule/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes the tables that this application wrote between its rounds; results that read them are gone then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
