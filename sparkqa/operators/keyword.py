"""Keyword search over a text table (op 41, also the retriever of the evaluation ops).

tf-idf: ``sum over the question's distinct words of tf(word, doc) * ln(N / df(word))``. Every
word counts, however common; a document that shares a word is a hit even where all its words
are in every document (score 0).

The index is written once and opened by any later search:

* ``docs`` (doc, key): documents numbered inside the tasks that read them, in key order; the upper bits of a number
  are its range of ``RANGE_DOCS`` documents;
* ``blocks`` (term, range, max_tf, docs, tfs), sorted by term: a term's postings of one range, with the largest count. A common
  word has one block a range, so no group gathers its postings;
* ``terms`` (term, df, idf).

A search numbers the words that are asked and packs their blocks, one row a range. It adds up ``idf * max_tf`` per question and range:
no document of the range can score more. The best ``PROBES`` ranges of each question are scored first, and then only those whose bound
reaches the question's k-th best score so far; all others are skipped unread. Results are exact. Bounds and scores are sparse products of
a range, or a few, and a chunk of questions, in numpy over Arrow's buffers; a range is sent once a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..session import finish_folder, materialize, path_exists, scratch_path, spread

RANGE_BITS = 10
RANGE_DOCS = 1 << RANGE_BITS
PROBES = 2                   # ranges a question is scored on before its threshold is known
FEW_RANGES = 24              # with no more ranges than that, all are scored at once
CHUNK_QUESTIONS = 65_536     # questions that meet a range in one task, and
CHUNK_WORDS = 1 << 22        # words they have, about
BOUND_RANGES = 16            # ranges whose bounds one task adds up, about
SLICE = 1 << 22              # additions done at once
FEW_HITS = 16                # no more hits a range than that are picked one by one
BOUND_SLACK = 1e-6
RANK_DECIMALS = 9            # scores rank at this precision, so summation order never reorders ties


@dataclass
class KeywordIndex:
    docs: DataFrame
    blocks: DataFrame
    terms: DataFrame
    key: str


BLOCK = [T.StructField("term", T.StringType()), T.StructField("range", T.LongType()), T.StructField("max_tf", T.IntegerType()),
         T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]


def _range_blocks(bits: int):
    """The blocks of each range of (doc, key, words) rows, which come in the order of their numbers, and a row without a
    term that holds the range's keys."""
    last = (1 << bits) - 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                # up to the end of the range that the first row is in
                held.append(batch.slice(0, last + 1 - (batch.column("doc")[0].as_py() & last)))
                batch = batch.slice(held[-1].num_rows)
                if (held[-1].column("doc")[-1].as_py() & last) == last:
                    yield _blocks_of(pa.Table.from_batches(held), bits)
                    held = []
        if held:
            yield _blocks_of(pa.Table.from_batches(held), bits)
    return make


def _blocks_of(rows: pa.Table, bits: int) -> pa.RecordBatch:
    keys, number = rows.column("key").combine_chunks(), rows.column("doc")[0].as_py() >> bits
    words = rows.column("words").combine_chunks()
    words = pc.if_else(keys.is_valid(), words, pa.scalar(None, words.type))         # a row without a key is never found
    sizes = pc.list_value_length(words).fill_null(0).to_numpy()
    terms = words.flatten().dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    pair, tf = np.unique((code << bits) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    term, first = np.unique(pair >> bits, return_index=True)
    ends = pa.array(np.append(first, len(pair)).astype("int32"))
    tf, n = tf.astype("int32"), len(term)
    most = np.maximum.reduceat(tf, first) if n else tf
    lists = [pa.ListArray.from_arrays(ends, v.astype("int32")) for v in (pair & ((1 << bits) - 1), tf)]
    blocks = [terms.dictionary.take(pa.array(term)), pa.array(np.full(n, number)), pa.array(most), *lists,
              pa.nulls(n, pa.list_(keys.type))]
    own = [pa.nulls(1, blocks[0].type), pa.array([number]), *[pa.nulls(1, b.type) for b in blocks[2:5]],
           pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
    names = ["term", "range", "max_tf", "docs", "tfs", "keys"]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b, o.cast(b.type)]) for b, o in zip(blocks, own)], names=names)


def build_index(docs: DataFrame, key: str, text: str, path: str | None = None) -> KeywordIndex:
    """Index over (key, text) rows, written to ``path`` (opened if it is there already) or to a fresh folder.

    Every row is a document, rows that repeat a key too; rows without key or text are counted but never found."""
    spark = docs.sparkSession
    if path and path_exists(spark, f"{path}/terms/_SUCCESS"):
        return open_index(spark, path)
    folder = scratch_path(spark, "keyword-index")
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))).sortWithinPartitions("key") \
        .select(F.monotonically_increasing_id().alias("doc"), "key", tokens("_text").alias("words"))
    keys = T.StructField("keys", T.ArrayType(rows.schema["key"].dataType))
    schema = T.StructType([*BLOCK, keys])
    # a range lies in one task, so its blocks are made there, and no posting is shuffled on its own
    rows.mapInArrow(_range_blocks(RANGE_BITS), schema).write.parquet(f"{folder}/ranges")
    written = spark.read.schema(schema).parquet(f"{folder}/ranges")
    numbered = written.where("term IS NULL").select("range", F.posexplode("keys").alias("at", "key"))
    numbered.select((F.shiftleft("range", RANGE_BITS) + F.col("at")).alias("doc"), "key").write.parquet(f"{folder}/docs")
    n_docs = spark.read.parquet(f"{folder}/docs").count()
    # one range partitioning serves the sort order of the files and the split of common words
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written.where("term IS NOT NULL").drop("keys").repartitionByRange(tasks, "term", "range") \
        .sortWithinPartitions("term", "range").write.parquet(f"{folder}/blocks")
    df = spark.read.parquet(f"{folder}/blocks").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    df.withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df"))).write.parquet(f"{folder}/terms")
    return open_index(spark, finish_folder(spark, folder, path) if path else folder)


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    docs, blocks, terms = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "blocks", "terms"))
    return KeywordIndex(docs.select("doc", "key"), blocks, terms, "key")


PACKED = [T.StructField("range", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("idf", T.ArrayType(T.DoubleType())),
          T.StructField("max_tf", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
          T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]


def _pack(rows: pa.Table) -> pa.Table:
    """The blocks of a range as one row, in the order of their words' numbers."""
    rows = rows.take(pc.sort_indices(rows.column("id")))
    packed = [rows.column("id"), rows.column("idf"), rows.column("max_tf"), pc.list_value_length(rows.column("docs")),
              pc.list_flatten(rows.column("docs")), pc.list_flatten(rows.column("tfs"))]
    one = [pa.array([v.to_numpy()], to_arrow_type(f.dataType)) for v, f in zip(packed, PACKED[1:])]
    return pa.table([rows.column("range").slice(0, 1).combine_chunks(), *one], names=[f.name for f in PACKED])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy()


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy()


def _met(ids: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked word stands in ``ids`` (sorted), and whether it is there."""
    at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
    return at, ids[at] == asked


def _bounds_fn(qtype: pa.DataType):
    """What the documents of each range can score at most, for every question that shares a word with the range."""
    def bounds(q: pa.Table, d: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and d.num_rows:
            words, inverse = np.unique(_flat(q.column("terms")), return_inverse=True)
            starts = np.cumsum(_lengths(q.column("terms")))[:-1]
            starts = np.concatenate([[0], starts])                   # every question has a word
            for n in range(d.num_rows):
                one = d.slice(n, 1)
                at, met = _met(_flat(one.column("ids")), words)
                most = np.where(met, (_flat(one.column("idf")) * _flat(one.column("max_tf")))[at], 0.0)
                shared = np.flatnonzero(np.logical_or.reduceat(met[inverse], starts))
                out.append((shared, np.full(len(shared), one.column("range")[0].as_py()), np.add.reduceat(most[inverse], starts)[shared]))
        rows, number, bound = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"qk": q.column("qk").cast(qtype).take(pa.array(rows)), "range": pa.array(number, pa.int64()), "bound": pa.array(bound)})
    return bounds


def _score_fn(k: int):
    def score(q: pa.Table, d: pa.Table) -> pa.Table:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        number = 0
        if q.num_rows and d.num_rows:
            number = d.column("range")[0].as_py() << RANGE_BITS
            found += _range_hits(_flat(q.column("terms")), _lengths(q.column("terms")), *(_flat(d.column(c)) for c in ("ids", "idf", "sizes", "docs", "tfs")), k)
        rows, cols, scores = (np.concatenate(x) for x in zip(*found))
        return pa.table({"qk": q.column("qk").take(pa.array(rows)), "doc": pa.array(number + cols, pa.int64()), "score": pa.array(scores)})
    return score


def _range_hits(terms, lengths, ids, idf, sizes, docs, tfs, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, document of the range, score): the ``k`` best documents of a range for each question, given as its words' numbers in order."""
    first = np.cumsum(sizes) - sizes
    values = np.repeat(idf, sizes) * tfs
    at, met = _met(ids, terms)
    # the questions' words as rows (question, block), in the order of numbers: a fixed order of additions
    who, block = np.repeat(np.arange(len(lengths)), lengths)[met], at[met]
    out = []
    step = max(1, SLICE // RANGE_DOCS)
    for low in range(0, len(lengths), step):
        high = min(low + step, len(lengths))
        a, b = np.searchsorted(who, [low, high])
        total = np.zeros((high - low) * RANGE_DOCS)
        shared = np.zeros(len(total), bool)
        done = a
        while done < b:                          # words whose blocks add up to about one slice
            upto = min(b, done + max(1, int(np.searchsorted(np.cumsum(sizes[block[done:b]]), SLICE))))
            n = sizes[block[done:upto]]
            post = np.repeat(first[block[done:upto]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat((who[done:upto] - low) * RANGE_DOCS, n) + docs[post]
            value = values[post]
            total += np.bincount(cell, value, len(total))
            shared[cell[value == 0]] = True      # a word of all documents adds nothing, but is shared
            done = upto
        shared |= total > 0
        total, shared = total.reshape(-1, RANGE_DOCS), shared.reshape(-1, RANGE_DOCS)
        ranked = np.where(shared, np.round(total, RANK_DECIMALS), -np.inf)
        whole = np.arange(high - low)
        if k > FEW_HITS:
            best = np.argsort(-ranked, axis=1, kind="stable")[:, :k]        # ties: smaller number, so smaller key
            hit = np.take_along_axis(shared, best, 1)
        else:
            best, hit = np.empty((high - low, min(k, RANGE_DOCS)), int), np.empty((high - low, min(k, RANGE_DOCS)), bool)
            for n in range(best.shape[1]):
                best[:, n] = ranked.argmax(axis=1)                          # the first of equals, too
                hit[:, n] = ranked[whole, best[:, n]] > -np.inf
                ranked[whole, best[:, n]] = -np.inf
        rows, cols = np.repeat(whole, best.shape[1])[hit.ravel()], best.ravel()[hit.ravel()]
        out.append((rows + low, cols, total[rows, cols]))
    return out


def _chunk(chunks: int):
    return F.pmod(F.xxhash64("qk"), F.lit(chunks)).cast("int").alias("chunk")


def _scored(visits: DataFrame, asks: DataFrame, blocks: DataFrame, chunks: int, k: int, qtype: T.DataType) -> DataFrame:
    """(qk, doc, score): up to ``k`` best documents per question and visited range."""
    q = visits.join(asks, "qk").select("*", _chunk(chunks))
    ranges = materialize(visits.select("range", _chunk(chunks)).distinct(), "visited-ranges")
    d = blocks.drop("max_tf").join(ranges, "range")
    schema = T.StructType([T.StructField("qk", qtype), T.StructField("doc", T.LongType()), T.StructField("score", T.DoubleType())])
    g = ["range", "chunk"]
    return q.groupBy(*g).cogroup(d.groupBy(*g)).applyInArrow(_score_fn(k), schema)


def _bounds(asks: DataFrame, blocks: DataFrame, chunks: int, qtype: T.DataType) -> DataFrame:
    """(qk, range, bound) of the ranges that share a word with a question."""
    groups = max(1, math.ceil(blocks.count() / BOUND_RANGES))
    d = blocks.select("range", "ids", "idf", "max_tf", F.pmod(F.xxhash64("range"), F.lit(groups)).cast("int").alias("group"),
                      F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    q = asks.select("*", _chunk(chunks), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    schema = T.StructType([T.StructField("qk", qtype), T.StructField("range", T.LongType()), T.StructField("bound", T.DoubleType())])
    g = ["group", "chunk"]
    return q.groupBy(*g).cogroup(d.groupBy(*g)).applyInArrow(_bounds_fn(to_arrow_type(qtype)), schema)


def _open_ranges(bounds: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(qk, range) of the ranges not probed whose bound reaches the k-th best score of the probed ones, or any if there are fewer hits."""
    nth = Window.partitionBy("qk").orderBy(F.desc("score"))
    threshold = hits.withColumn("n", F.row_number().over(nth)).where(F.col("n") == k).select("qk", F.col("score").alias("least"))
    rest = bounds.where(F.col("turn") > PROBES).join(threshold, "qk", "left") \
        .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - BOUND_SLACK))
    return materialize(rest.select("qk", "range"), "open-ranges")


def search(questions: DataFrame, qkey: str, qtext: str, index: KeywordIndex, k: int = 3, key: str = "key") -> DataFrame:
    """(qkey, key, score, rank): k best documents per question; ties by the smaller key, of any type, then in the order of the
    index. Rows of one question key ask together; rows without a text have nothing to ask."""
    qtype = questions.schema[qkey].dataType
    qt = questions.select(F.col(qkey).alias("qk"), F.explode(F.array_distinct(tokens(qtext))).alias("term")).distinct()
    asked = materialize(qt.join(index.terms.select("term", "idf"), "term"), "question-terms")
    words = materialize(asked.select("term", "idf").distinct().withColumn("id", F.monotonically_increasing_id()), "asked-words")
    asks = asked.select("qk", "term").join(words.select("term", "id"), "term") \
        .groupBy("qk").agg(F.sort_array(F.collect_list("id")).alias("terms"))       # a question's own words
    asks = materialize(asks, "questions")
    n = asks.agg(F.count(F.lit(1)).alias("asks"), F.sum(F.size("terms")).alias("words")).first()
    chunks = max(1, math.ceil(n["asks"] / CHUNK_QUESTIONS), math.ceil((n["words"] or 0) / CHUNK_WORDS))
    blocks = index.blocks.join(words, "term").select("range", "id", "idf", "max_tf", "docs", "tfs")
    blocks = materialize(blocks.groupBy("range").applyInArrow(_pack, T.StructType(PACKED)), "asked-blocks")
    likely = Window.partitionBy("qk").orderBy(F.desc("bound"), "range")
    bounds = materialize(_bounds(asks, blocks, chunks, qtype).withColumn("turn", F.row_number().over(likely)), "range-bounds")
    probes = PROBES if (bounds.agg(F.max("turn")).first()[0] or 0) > FEW_RANGES else FEW_RANGES
    hits = _scored(bounds.where(F.col("turn") <= probes).select("qk", "range"), asks, blocks, chunks, k, qtype)
    if probes < FEW_RANGES:
        hits = materialize(hits, "probe-hits")
        hits = hits.unionByName(_scored(_open_ranges(bounds, hits, k), asks, blocks, chunks, k, qtype))
    # at most k rows per question and visited range; written, so the join to the document keys sees its real size
    named = materialize(hits, "range-hits").join(index.docs.withColumnRenamed(index.key, "dk"), "doc")
    w = Window.partitionBy("qk").orderBy(F.round("score", RANK_DECIMALS).desc(), F.col("dk").asc(), F.col("doc").asc())
    best = named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return materialize(best.select(F.col("qk").alias(qkey), F.col("dk").alias(key), "score", "rank"), "keyword-hits")


def keyword_topk(questions: DataFrame, qkey: str, qtext: str, docs: DataFrame | KeywordIndex, key: str, text: str = "", k: int = 3) -> DataFrame:
    """``search`` in an index, or in a table that is indexed for it."""
    index = docs if isinstance(docs, KeywordIndex) else build_index(docs, key, text)
    return search(questions, qkey, qtext, index, k, key)


def keyword_top1(questions: DataFrame, qkey: str, qtext: str, docs: DataFrame | KeywordIndex, key: str, text: str = "") -> DataFrame:
    """(qkey, key, score): the best document per question."""
    return keyword_topk(questions, qkey, qtext, docs, key, text, k=1).drop("rank")
