"""Proportional stratified interleaving: shards that all match the mixture of the sources.

Rows are shuffled by a seeded hash inside their source; the row of rank r among n rows of a
source gets the fractional rank (2r+1)/2n. Sorting all rows by it interleaves the sources in
proportion, and cutting that order into equal runs gives shards whose row counts differ by at
most one and whose share of each source differs from the whole by about one row.

Both orders (inside a source, over all rows) are numbered by ``ranks.rank_in_groups``: a source
with a third of all rows is spread over many tasks, and no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ranks import buckets_for, rank_in_groups, split_hot

ROW_BYTES = 16


def shard(df: DataFrame, shards: int, source_col: str, id_col: str, seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to shards-1) and ``slot`` (long, gapless from 0 inside a shard).

    Law ``rows``: counts of any two shards differ by at most one. An id on many rows gets buckets of its own. Rows without a source form a
    stratum of their own, rows without an id come first among equal hashes, repeated rows are rows
    like any other, and an empty table gives an empty result. The order depends on seed, source and id
    only; rows equal in both are interchangeable. Columns of ``df`` named ``shard`` or ``slot`` are
    replaced, all others are carried (written once and read back), so select those needed first."""
    carried = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    rows = materialize(df.select(carried.alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"),
                                 F.xxhash64(F.lit(seed), F.col(id_col)).alias("mix"),
                                 F.monotonically_increasing_id().alias("at")), "shard-rows")
    total = rows.count()
    buckets = buckets_for(rows, total)
    ranked = rank_in_groups(split_hot(rows, buckets, total, "id", "mix", "at"), ["source"], "bucket", ["mix", "id"])
    # equal fractions of two sources: the seeded hash decides, so no source always comes first
    part = (2 * F.col("rank") + 1) / (2 * F.col("group_rows"))
    placed = materialize(ranked.select("row", "id", "mix", part.alias("part")).withColumn(
        "bucket", F.least(F.floor(F.col("part") * buckets), F.lit(buckets - 1)).cast("int")), "shard-order")
    order = rank_in_groups(placed, [], "bucket", ["part", "mix", "id"])
    # position p of n rows goes to shard p * shards div n, whose first position is ceil(shard * n / shards)
    cut = order.withColumn("shard", F.expr(f"(rank * {shards}) div group_rows"))
    first = F.expr(f"(shard * group_rows + {shards - 1}) div {shards}")
    return cut.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, ``size`` (UTF-8 bytes of the text plus 16) and ``text_crc32``; null text: no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
