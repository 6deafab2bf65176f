"""Triggered index sync (op 14): process only what changed since the last sync, then stop.

Two forms:

* ``sync_index_batch(old, source)``: a snapshot diff. Rows whose ``(key, sha-256(text))``
  is unchanged are kept without re-embedding (left-semi join); new or edited rows are
  embedded (left-anti join); keys gone from the source drop out. Only keys and 32-byte
  digests are shuffled for the comparison, never the texts.
* ``sync_index_stream(...)``: Structured Streaming over a folder of change files with
  ``trigger(availableNow=True)``, merge-on-read. The first micro-batch writes the base
  index ``base/upto=<batch_id>``; every later batch writes only its own changed rows
  (embedded upserts and delete markers) to ``delta/batch=<batch_id>``, so a sync costs
  O(changes), never a rewrite of the index. Both writes overwrite their own folder, so a
  retried ``foreachBatch`` rewrites the same rows and never duplicates them.
  ``read_index`` applies the latest change per key over the newest base (one grouped
  aggregate over the deltas, one anti-join of the base with the changed keys);
  ``compact_index`` folds the deltas into a new base when they pile up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..operators.embed import embed
from ..operators.vectors import VectorIndex, table_index
from ..session import list_names, path_exists


def text_digest(text: str):
    """SHA-256 of the text: equal digests mean equal texts (no practical collisions)."""
    return F.unhex(F.sha2(F.col(text), 256))


def index_rows(source: DataFrame, key: str, text: str) -> DataFrame:
    """Embedded index rows for a keyed text table."""
    x = source.select(key, text, text_digest(text).alias("text_hash"),
                      F.size(tokens(text)).alias("n_terms"))
    return embed(x, text)


def sync_index_batch(old: DataFrame | None, source: DataFrame, key: str, text: str) -> DataFrame:
    """Index of ``source`` reusing the rows of ``old`` whose text is unchanged."""
    if old is None:
        return index_rows(source, key, text)
    src = source.select(key, text, text_digest(text).alias("text_hash"))
    kept = old.join(src.select(key, "text_hash"), [key, "text_hash"], "left_semi")
    changed = src.join(old.select(key, "text_hash"), [key, "text_hash"], "left_anti")
    fresh = index_rows(changed.select(key, text), key, text)
    return kept.unionByName(fresh)


def _complete(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Ids of the folders ``<root>/<prefix>=<id>`` whose write committed (``_SUCCESS``)."""
    ids = [int(p.split("=", 1)[1]) for p in list_names(spark, root) if p.startswith(prefix + "=")]
    return sorted(i for i in ids if path_exists(spark, f"{root}/{prefix}={i}/_SUCCESS"))


def _latest_changes(deltas: DataFrame, key: str) -> DataFrame:
    """Last change per key over all delta batches (``seq`` = batch id); the partial
    aggregate combines map-side, so a key changed in many batches ships one row per task."""
    rest = [c for c in deltas.columns if c != key]
    g = deltas.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_r"))
    return g.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def read_index(spark: SparkSession, index_path: str, key: str | None = None) -> DataFrame | None:
    """Current index: the newest complete base with every later delta applied, or None
    before the first sync. ``key`` defaults to the key recorded by the sync."""
    bases = _complete(spark, f"{index_path}/base", "upto")
    if not bases:
        return None
    upto = bases[-1]
    base = spark.read.parquet(f"{index_path}/base/upto={upto}")
    later = [b for b in _complete(spark, f"{index_path}/delta", "batch") if b > upto]
    if not later:
        return base
    key = key or base.columns[0]
    deltas = spark.read.parquet(*[f"{index_path}/delta/batch={b}" for b in later])
    latest = _latest_changes(deltas, key)
    # changed keys are few next to the base: AQE broadcasts them when its size check
    # allows, else both sides shuffle on the key
    kept = base.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.filter(~F.col("deleted")).drop("deleted", "seq"))


def open_synced(spark: SparkSession, index_path: str, key: str) -> VectorIndex | None:
    """The synced index, base and deltas together, ready for the searches of ``operators.vectors``; None before
    the first sync."""
    rows = read_index(spark, index_path, key)
    return None if rows is None else table_index(rows, key)


def compact_index(spark: SparkSession, index_path: str, key: str | None = None) -> None:
    """Fold every committed delta into a new base ``upto=<last delta>``; readers switch
    to it once it is complete, and older folders can then be removed by retention."""
    later = _complete(spark, f"{index_path}/delta", "batch")
    bases = _complete(spark, f"{index_path}/base", "upto")
    if not bases or not later or later[-1] <= bases[-1]:
        return
    merged = read_index(spark, index_path, key)
    merged.write.mode("overwrite").parquet(f"{index_path}/base/upto={later[-1]}")


def sync_index_stream(spark: SparkSession, source_dir: str, schema: T.StructType, index_path: str,
                      checkpoint: str, key: str, text: str, deleted_col: str | None = None,
                      continuous_every: str | None = None):
    """Run one triggered sync over new change files under ``source_dir`` and stop; with
    ``continuous_every`` (e.g. ``"1 minute"``) the same query keeps running on that
    processing-time trigger instead, and the running query is returned.

    Each change row is an upsert of ``(key, text)``; with ``deleted_col`` a true value
    deletes the key. A key changed several times in one batch keeps its last change (``seq``
    column if there is one, then the time of the file), so the index holds one row per key; changes without a key
    are left out. Returns the finished streaming query."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        sess = batch.sparkSession
        # one row per key: the last change wins, by its sequence number (if the files carry one), then by the
        # time and name of its file; a deletion beats an upsert of the same file
        order = [F.col("seq")] if "seq" in batch.columns else []
        order += [F.col("_file_time"), F.col("_file"), F.coalesce(F.col(deleted_col), F.lit(False)) if deleted_col else F.lit(False),
                  F.col(text)]
        rest = F.struct(*[c for c in batch.columns if c != key])
        ch = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("r")).select(key, "r.*")
        gone = F.col(deleted_col) if deleted_col else F.lit(False)
        ch = ch.select(key, text, F.coalesce(gone, F.lit(False)).alias("deleted"))
        fresh = index_rows(ch.filter(~F.col("deleted")).select(key, text), key, text)
        if not _complete(sess, f"{index_path}/base", "upto"):
            fresh.write.mode("overwrite").parquet(f"{index_path}/base/upto={batch_id}")
            return
        marks = ch.filter(F.col("deleted")).select(key)
        rows = (fresh.withColumn("deleted", F.lit(False))
                .unionByName(marks.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
                .withColumn("seq", F.lit(batch_id).cast("bigint")))
        rows.write.mode("overwrite").parquet(f"{index_path}/delta/batch={batch_id}")

    source = spark.readStream.schema(schema).parquet(source_dir)
    w = (source.select("*", F.col("_metadata.file_modification_time").alias("_file_time"), F.col("_metadata.file_path").alias("_file"))
         .writeStream.foreachBatch(upsert)
         .option("checkpointLocation", checkpoint))
    if continuous_every:
        return w.trigger(processingTime=continuous_every).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q
