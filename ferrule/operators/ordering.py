"""Positions in one order over all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.plans.state import kept


def positions(df: DataFrame, order, name: str = "pos", first: int = 1) -> DataFrame:
    """df with the position of each row in the order (columns or names), from `first` on.

    Rows are range-partitioned by the order and numbered in their partition; to this comes the number of rows in the partitions before, a sum
    over one row per partition. The order should leave no ties.
    """
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    s = kept(s.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("_at"))), "positions")
    sizes = s.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return s.join(before, "_part").withColumn(name, F.col("_before") + F.col("_nth") + (first - 1)).drop("_part", "_at", "_nth", "_before")
