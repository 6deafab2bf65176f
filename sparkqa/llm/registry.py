"""Registered queries of the training-data operators: one ``opN_<name>`` per operator.

Each applies its operator with production parameters to its whole table and derives the
columns of its contract from the operator's result. ``ORACLES`` has DuckDB SQL where SQL can
express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, curves, exact_dedup, language, licenses, lm, packing, pieces, prefixes, quality, sharding, simhash, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 40
END_ID = 2


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing with the public 50k byte-level vocabulary (its rank file; the ids are the same) and end id 2."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_ID)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, sf):
    return licenses.licenses(table(spark, sf, "documents"))


@query
def op2_stratified_shards(spark, sf):
    sizes = sharding.document_sizes(table(spark, sf, "documents"))
    return sharding.shard(sizes, SHARDS, "source", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "source")


@query
def op3_exact_duplicates(spark, sf):
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


@query
def op4_best_fit_packing(spark, sf):
    return pack_documents(table(spark, sf, "documents"))


@query
def op5_hilbert_neighbours(spark, sf):
    return curves.nearest(table(spark, sf, "embeddings"))


@query
def op6_simhash_components(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op7_sentencepiece_ids(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.encode(table(spark, sf, "documents"), path, "bpe", keep_text=False, verify=True)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


@query
def op8_ordinal_toxicity(spark, sf):
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_ppm_scores(spark, sf):
    return lm.language_model_scores(table(spark, sf, "documents"))


@query
def op10_quality_trees(spark, sf):
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op11_language_hierarchy(spark, sf):
    return language.languages(table(spark, sf, "documents"))


@query
def op12_vector_codes(spark, sf):
    return codes.vector_codes(table(spark, sf, "embeddings"))


@query
def op13_conversation_prefixes(spark, sf):
    return prefixes.conversation_prefixes(table(spark, sf, "conversations"))


ORACLES: dict[str, str] = {
    "op3_exact_duplicates": """
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 sha256(translate(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS text_sha256
          FROM documents),
        w AS (
          SELECT doc_id, text_sha256,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op12_vector_codes": """
        WITH c AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS a FROM c, range(16) t(p)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a AS b FROM parts QUALIFY e < 64),
        """ + "".join(f"""
        n{i} AS (SELECT vec_id, any_value(label) AS label, p, any_value(a) AS a,
                        min(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS m
                 FROM parts JOIN b{i} USING (p) GROUP BY vec_id, p),
        s{i} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY place) AS b FROM (
                   SELECT p, m % 64 AS e, place, sum(a[place])::DOUBLE AS s, count(*) AS n FROM n{i}, range(1, len(a) + 1) t(place) GROUP BY ALL)
                 GROUP BY p, e),
        b{i + 1} AS (SELECT p, e, coalesce(s{i}.b, b{i}.b) AS b FROM b{i} LEFT JOIN s{i} USING (p, e)),""" for i in range(2)) + """
        last AS (SELECT vec_id, any_value(label) AS label, p,
                        min(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS m
                 FROM parts JOIN b2 USING (p) GROUP BY vec_id, p),
        coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error
                  FROM last GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(list_aggregate(b, 'string_agg', ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
        FROM coded""",
    "op13_conversation_prefixes": r"""
        WITH t AS (
          SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d,
                 md5(concat(length(coalesce(role, '')), ':', role, text)) AS turn,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
          FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
          SELECT c, count(*) AS n, c - c % 20 AS base,
                 3 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                                 lambda v, s: list_reduce(list_concat([xor(v, s)], range(8)),
                                                          lambda u, i: xor(u >> 1, 3988292384 * (u & 1)))) % 4 AS h
          FROM t GROUP BY c),
        lent AS (SELECT o.c, o.base, o.h, least(o.h, coalesce(b.n, 0)) AS l, l + greatest(o.n - o.h, 0) AS n
                 FROM own o LEFT JOIN own b ON b.c = o.base),
        turns AS (
          SELECT lent.c, d, turn, words FROM lent JOIN t ON t.c = base AND d <= l
          UNION ALL SELECT lent.c, d - h + l, turn, words FROM lent JOIN t ON t.c = lent.c AND d > h),
        members AS (
          SELECT c, d, list(turn) OVER (PARTITION BY c ORDER BY d) AS p, words FROM turns
          UNION ALL SELECT c, 0, []::VARCHAR[], 0 FROM own),
        nodes AS (
          SELECT p, len(p) AS d, min(m.c) AS conv_id, count(*) AS n, max(words) AS words,
                 sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE m.d = lent.n), '')) AS ends
          FROM members m JOIN lent USING (c) GROUP BY p),
        kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
        below AS (
          SELECT list_slice(p, 1, a) AS p, count(*) FILTER (WHERE k IS NULL) AS leaves, sum((n - 1) * words) AS saved
          FROM (SELECT nodes.*, k, unnest(range(0, d + 1)) AS a FROM nodes LEFT JOIN kids USING (p)) GROUP BY 1)
        SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(k, 0) AS n_children,
               leaves AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
        FROM nodes LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.p = list_slice(nodes.p, 1, nodes.d - 1)
        LEFT JOIN kids ON kids.p = nodes.p JOIN below ON below.p = nodes.p""",
}
