"""Exact ranks inside groups of any size, without a task that holds a whole group.

A window over ``group`` alone sorts a hot group in one task. Here every row also gets a bucket,
an interval of a uniform 64-bit hash, so a group's order is "bucket, then hash inside it". Rows are numbered
inside ``(group, bucket)``, bucket counts are summed up per group, and the two are added: a task
never holds more of a group than one bucket, and the number of buckets grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

ROWS_PER_BUCKET = 100_000


def buckets_for(df: DataFrame, rows: int) -> int:
    """Buckets for a table of so many rows: small enough for a task's sort, and several for
    each task of a shuffle so that a hot group is spread over all of them."""
    return max(4 * parallelism(df.sparkSession), -(-rows // ROWS_PER_BUCKET))


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Interval number (0 to buckets-1) of a signed 64-bit hash, rising with the hash."""
    top = F.shiftright(hashed, 32) + F.lit(1 << 31)  # 0 to 2**32-1
    return F.shiftright(top * F.lit(buckets), 32).cast("int")


def split_hot(rows: DataFrame, buckets: int, total: int, hot_id: str, mix: str, row: str) -> DataFrame:
    """``rows`` with ``bucket``: the hash bucket of ``mix``, and for an id with more rows than a bucket holds on
    average, buckets of its own right behind that one, dealt by the written row number ``row``. Buckets order as structs, so ranks
    depend on ``mix`` alone, but for the rows of one hot id among each other."""
    size = max(total // buckets, 1)
    hot = materialize(rows.groupBy(F.col(hot_id).alias("_hot")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > size), "hot-ids")
    dealt = F.pmod(F.xxhash64(row), F.ceil(F.col("_rows") / size)).cast("int") + 1
    split = F.col("_rows").isNotNull()
    bucket = F.struct(hash_bucket(F.col(mix), buckets).alias("at"), F.when(split, F.col(mix)).otherwise(F.lit(-(1 << 63))).alias("mix"),
                      F.when(split, dealt).otherwise(F.lit(0)).alias("part"))
    return rows.join(hot, F.col(hot_id).eqNullSafe(F.col("_hot")), "left").withColumn("bucket", bucket).drop("_hot", "_rows")


def rank_in_groups(df: DataFrame, groups: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (long, gapless from 0 inside each group) and ``group_rows`` (long).

    ``bucket`` is a non-null column that can be ordered; rows rank by ``bucket`` first, then by ``order``.
    Null group values are a group of their own. ``df`` is read twice, so pass a written or
    otherwise cheap table."""
    counts = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*groups)
    before = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col(bucket).alias("_b"),
        (F.sum("n").over(whole.orderBy(bucket)) - F.col("n")).alias("_before"),
        F.sum("n").over(whole).alias("group_rows"),
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside).cast("long") - 1)
    on = F.col(bucket) == F.col("_b")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    drop = ["_inside", "_before", "_b", *[f"_g{i}" for i in range(len(groups))]]
    return numbered.join(before, on).withColumn("rank", F.col("_before") + F.col("_inside")).drop(*drop)
