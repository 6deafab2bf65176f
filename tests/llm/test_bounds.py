"""One id on a third of the rows: samples stay bounded, and no bucket holds the id's rows."""

from collections import Counter

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from sparkqa.llm import packing, quality, ranks, registry, sharding, toxicity
from sparkqa.session import table


@pytest.fixture(scope="module")
def hot(spark):
    """The documents, and one labelled id on 4,000 more rows of several texts."""
    docs = table(spark, SF_SMALL, "documents")
    ident = table(spark, SF_SMALL, "labels").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").agg(F.min("doc_id")).first()[0]
    more = spark.range(4000).select(F.lit(ident).alias("doc_id"), F.concat(F.lit("plain words "), (F.col("id") % 7).cast("string")).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(13).cast("long").alias("n_chars"))
    return docs.unionByName(more)


def test_fits_take_one_row_per_id(spark, hot, monkeypatch):
    labels = table(spark, SF_SMALL, "labels")
    seen = []
    monkeypatch.setattr(quality, "fit_trees", lambda x, y: seen.append(len(x)))
    stats = quality.document_statistics(hot, "doc_id", "text")
    for rows in (50, 60_000):
        quality.fit(stats, labels, sample_rows=rows)
        quality.fit_documents(hot, labels, sample_rows=rows)
    known = labels.where("quality IS NOT NULL").where(~quality.held_out("doc_id", 5)).select("doc_id").distinct().count()
    assert seen == [50, 50, known, known]


def test_fit_of_documents_equals_fit_of_statistics(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    a = quality.fit(quality.document_statistics(docs, "doc_id", "text"), labels)
    b = quality.fit_documents(docs, labels)
    assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.leaf == b.leaf).all()


def test_toxicity_sample(spark, hot):
    """The fitting task gets one row an id, and no text over the bound."""
    labels = table(spark, SF_SMALL, "labels")
    counted = lambda batches: iter([toxicity.pa.RecordBatch.from_arrays(
        [toxicity.pa.array(["w"]), toxicity.pa.array([sum(b.num_rows for b in batches)], toxicity.pa.int64()), toxicity.pa.array([1.0])], ["kind", "at", "value"])])
    original = toxicity.fit_task
    toxicity.fit_task = counted
    try:
        model = toxicity.fit(hot, labels, sample_rows=40)
        none = toxicity.fit(hot.withColumn("text", F.repeat(F.lit("x"), toxicity.SAMPLE_BYTES + 1)), labels, sample_rows=40)
    finally:
        toxicity.fit_task = original
    assert list(model.weights) == [40] and list(none.weights) in ([0], [])


def test_hot_ids_are_split(spark, hot):
    total = hot.count()
    rows = hot.select(F.col("doc_id").alias("id"), F.xxhash64(F.lit(1), "doc_id").alias("mix"), F.monotonically_increasing_id().alias("at"))
    found = Counter(r.bucket for r in ranks.split_hot(rows, 32, total, "id", "mix", "at").collect())
    assert sum(found.values()) == total and max(found.values()) <= 2 * total / 32
    sharded = sharding.shard(hot, 10, "source", "doc_id")
    counts = Counter(r["shard"] for r in sharded.collect())
    assert sum(counts.values()) == total and max(counts.values()) - min(counts.values()) <= 1
    none = hot.withColumn("doc_id", F.lit(None).cast("long"))
    assert sharding.shard(none, 10, "source", "doc_id").count() == total


def test_hot_ids_leave_the_order_of_others(spark):
    df = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "'s' AS source", "id AS row")
    places = [sorted((r["shard"], r.slot) for r in sharding.shard(df.repartition(n), 5, "source", "id").where("id <> 7").select("id", "shard", "slot").collect())
              for n in (3, 8)]
    assert places[0] == places[1]


def test_packing_of_a_hot_id(spark, hot):
    packed = registry.pack_documents(hot)
    by_sequence = {}
    for r in packed.collect():
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
