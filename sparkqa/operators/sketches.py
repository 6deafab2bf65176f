"""Latency sketches by day: written once a day, merged on read (ops 57, 59).

A sketch is a histogram with buckets of a fixed relative width: a value is counted, in units of a thousandth, under its
leading ``BITS`` binary digits. Bucket numbers are integers that depend on the value alone, so sketches of days, files or
clusters merge by adding counts, in any order, to what one pass over all the rows would have given. A group has
``64 * 2**(BITS - 1)`` buckets of each sign at most, however many rows it has.

The percentile read from a sketch is the middle of the bucket that holds the exact nearest-rank percentile: off by
``2**-BITS`` of the value at most, plus one unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 8
UNITS = 1000                 # units to one of the value's own unit
LAST = 1 << 62               # larger values share the last bucket


def bucket(value: Column) -> Column:
    """Lower edge, in units and with the value's sign, of the bucket of a value; null for null and NaN."""
    size = F.floor(F.least(F.abs(value.cast("double")) * UNITS, F.lit(float(LAST)))).cast("bigint")
    cut = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    edge = F.call_function("shiftleft", F.call_function("shiftright", size, cut), cut)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.when(value < 0, -edge).otherwise(edge))


def middle(edge: Column) -> Column:
    """The value that stands for a bucket; buckets of one unit stand for that unit."""
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.length(F.bin(F.abs(edge))) - BITS, F.lit(0)))
    return (edge + F.signum(edge) * (width - 1) / 2) / UNITS


def day_sketches(trace: DataFrame, groups: list[str], value: str, time: str = "ts") -> DataFrame:
    """(day, groups, bucket, n) of a call log; rows without a value count under a null bucket, rows without a time
    under a null day. One aggregate, combined map-side."""
    return trace.groupBy(F.to_date(time).alias("day"), *groups, bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def write_days(sketches: DataFrame, path: str) -> None:
    """Writes whole days, one folder each: a day that is written again is replaced, the others stay."""
    sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Sketches of the days from ``first`` to ``last``, both included (dates as text; none: no limit, the null day too).
    Other days' folders are not opened."""
    days = spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))
    if first is not None:
        days = days.filter(F.col("day") >= F.lit(first).cast("date"))
    return days if last is None else days.filter(F.col("day") <= F.lit(last).cast("date"))


def percentiles(sketches: DataFrame, groups: list[str | Column], ps: dict[str, float]) -> DataFrame:
    """Groups, ``calls`` (rows, with or without a value) and one column per entry of ``ps``, null without values.

    Null group values are a group of their own. A window meets merged buckets only, never rows."""
    merged = sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))
    names = [c for c in merged.columns if c not in ("bucket", "n")]
    counted = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)
    whole = Window.partitionBy(*names)
    at = merged.withColumns({"_upto": F.sum(counted).over(whole.orderBy(F.col("bucket").asc_nulls_first())),
                             "_all": F.sum(counted).over(whole)})
    picks = [F.min(F.when(F.col("bucket").isNotNull() & (F.col("_upto") >= F.ceil(F.col("_all") * F.lit(float(p)))), F.col("bucket")))
             .alias(name) for name, p in ps.items()]
    picked = at.groupBy(*names).agg(F.sum("n").alias("calls"), *picks)
    return picked.select(*names, "calls", *[middle(F.col(name)).alias(name) for name in ps])
