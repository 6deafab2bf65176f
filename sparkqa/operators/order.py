"""Positions inside groups of any size.

``row_number`` over a window sorts each group in one task; a group with a third of all rows would
land there whole. Here the rows are range-partitioned on (group, order), so a big group spans
several tasks; rows are numbered per (partition, group) segment, and the rows of the segments before are
added (at most partitions + groups rows to sum up)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def with_position(df: DataFrame, group: str, order: list[str], out: str = "pos") -> DataFrame:
    """``df`` with ``out`` (bigint): 0, 1, ... inside each ``group`` in the given order. Null groups are one
    group; rows equal in group and order may take either place."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, group, *order).withColumn("_pid", F.spark_partition_id())
    rows = materialize(dealt, "positions")             # the partitions must not change between the two reads
    seg = rows.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid")
    seg = seg.select(F.col("_pid").alias("_p"), F.col(group).alias("_g"), (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("_pid", group).orderBy(*order)
    numbered = rows.withColumn("_in", F.row_number().over(inside).cast("bigint") - 1)
    on = (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))
    return numbered.join(seg, on).withColumn(out, F.col("_start") + F.col("_in")).drop("_pid", "_p", "_g", "_start", "_in")
