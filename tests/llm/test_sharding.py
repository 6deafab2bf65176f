"""Laws of the shards: gapless slots, row counts, and the mixture of sources in each shard."""

import zlib
from collections import Counter

import pytest
from conftest import SF_SMALL

from edge import clashing, documents, empty, rows
from sparkqa.llm import ranks, registry, sharding
from sparkqa.session import table


def check(found, total, shards):
    counts = Counter(r["shard"] for r in found)
    assert sum(counts.values()) == total
    assert all(0 <= s < shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))


def test_query(spark):
    docs = {r.doc_id: r for r in table(spark, SF_SMALL, "documents").collect()}
    found = registry.QUERIES["op2_stratified_shards"](spark, SF_SMALL).collect()
    check(found, len(docs), registry.SHARDS)
    for r in found:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_mixture_matches_in_every_shard(spark):
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    found = sharding.shard(df.repartition(8), 10, "source", "id").collect()
    check(found, 4000, 10)
    whole = Counter(r["source"] for r in found)
    for s in range(10):
        mine = Counter(r["source"] for r in found if r["shard"] == s)
        assert all(abs(mine[k] - n / 10) <= 2 for k, n in whole.items())
    again = sharding.shard(df.repartition(3), 10, "source", "id")
    assert rows(again) == sorted((tuple(r) for r in found), key=repr)
    other = sharding.shard(df, 10, "source", "id", seed=2)
    assert rows(other) != rows(again)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_edge_rows(spark, shards):
    found = sharding.shard(documents(spark), shards, "source", "doc_id").collect()
    check(found, documents(spark).count(), shards)
    odd = sharding.shard(clashing(spark), shards, "source", "doc_id")
    check(odd.collect(), documents(spark).count(), shards)
    assert odd.columns.count("shard") == odd.columns.count("slot") == 1
    assert sharding.shard(empty(spark), shards, "source", "doc_id").collect() == []


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "IF(id % 10 = 0, NULL, 'hot') AS g").withColumn(
        "b", ranks.hash_bucket(__import__("pyspark").sql.functions.xxhash64("id"), 32))
    found = ranks.rank_in_groups(df, ["g"], "b", ["id"]).collect()
    for g in (None, "hot"):
        mine = sorted((r["b"], r["id"], r["rank"]) for r in found if r["g"] == g)
        assert [m[2] for m in mine] == list(range(len(mine)))
        assert {r["group_rows"] for r in found if r["g"] == g} == {len(mine)}
    assert {r["b"] for r in found} == set(range(32))
