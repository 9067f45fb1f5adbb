"""Reading tables, the shared folder, and the held-out rule."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank of a null id: below every other.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Rows hold whole texts; a reader's batch of 4096 of them, or an Arrow batch of 10,000, is tens of MB in single arrays, several times over.
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset a local session, whose tasks run in the driver, takes a temporary one; a cluster gets an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/ferrule/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes what this application wrote between its steps; no result that is still to be computed may need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ferrule/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ferrule_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written(); only once what was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._ferrule_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of two longs that may be broadcast: 64 MB.
SMALL = 1 << 22


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table of a few numbers a row, marked for a broadcast if it is as small as that; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def sized(df: DataFrame, source: DataFrame, mb: int = 32) -> DataFrame:
    """df in as many partitions as source has `mb` megabytes (by the planner's estimate), and at least as many as there are cores: few, full files.

    For what a scan feeds alone: behind a join one task would hold the hash tables of all the partitions that it was given.
    """
    estimate = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(int(min(1 << 20, max(df.sparkSession.sparkContext.defaultParallelism, -(-estimate // (mb << 20))))))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows to learn from; a null id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def hex64(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")
