"""Language-model scores: prediction by partial matching (PPM) over bytes, pretrained on the corpus.

The model is the context trie of order ``ORDER`` over the normalised text (A-Z lowered, words joined
by one space, then an end byte): the count of each byte after each context of up to four bytes.
Escapes follow method C (a context with n bytes seen, d of them distinct, escapes with d / (n + d)), and a byte that is
predicted after an escape is counted without those seen in the longer context (symbol exclusion). Below the root
every byte not excluded is equally likely.

No task holds the trie or the vocabulary. The corpus is cut into chunks of bounded size; each
counts its own words and grams (five bytes), the counts are summed up by key over the
corpus, and a chunk gets back the numbers of its own keys only, together with its texts. What
is gathered grows with the corpus, what a task holds with its chunk. The trie below the last two context bytes is
one group (at most 2**24 grams); the orders above it, at most 2**16 counts, go to every group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialize

ORDER = 4
FOLDS = 10
CHUNK_BYTES = 32 << 20
GRAM_BLOCK = 2 << 20
PAD = b"\n" * ORDER  # white space never occurs in words, so it can mark start and end
END = b"\n"
ALPHA = 0.1

PACKED = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("held", pa.bool_()), ("packed", pa.binary())])
LOCAL = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
SCORED = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base", pa.float64()), ("score", pa.float64()), ("distinct", pa.int64()), ("train", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def pack_chunks(chunk_bytes: int):
    """Numbers the chunks of a task, each of about ``chunk_bytes``; texts leave normalised and compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        chunk, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for ident, held, text in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    words = b" ".join((text or "").encode().lower().split())
                    if size >= chunk_bytes:
                        chunk, size = chunk + 1, 0
                    size += len(words) + 64
                    rows.append((chunk, ident, held, pack(words)))
                if rows:
                    yield record(rows, PACKED)
    return run


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams (context and byte, the byte lowest) of each text and its end; grams per text."""
    buffer = np.frombuffer(b"".join(PAD + t + END for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    codes = np.zeros(len(buffer) - ORDER, np.int64)
    for i in range(ORDER + 1):
        codes = (codes << 8) | buffer[i:len(buffer) - ORDER + i]
    # texts lie ORDER bytes apart: the grams that would span the padding go
    keep = np.ones(len(codes), bool)
    starts = np.cumsum(sizes + ORDER)[:-1]
    for i in range(ORDER):
        keep[starts - ORDER + i] = False
    return codes[keep], sizes


def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and grams of each chunk with their counts in training texts (0: only held-out texts have them)."""
    unpack = zstandard.ZstdDecompressor().decompress
    chunk, words, grams, waiting, size = None, Counter(), [], [], 0

    def fold() -> None:
        for train in (True, False):
            texts = [t for t, held in waiting if held != train]
            if texts:
                codes, n = np.unique(gram_codes(texts)[0], return_counts=True)
                grams.append((codes, n if train else np.zeros(len(n), np.int64)))
        waiting.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        if chunk is None:
            return
        fold()
        codes, at = np.unique(np.concatenate([c for c, _ in grams]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in grams])).astype(np.int64)
        of = lambda k: pa.array(np.full(k, chunk, np.int64))
        nothing = pa.nulls
        yield pa.RecordBatch.from_arrays([of(len(codes)), nothing(len(codes), pa.binary()), pa.array(codes), pa.array(n)], schema=LOCAL)
        keys, counts = list(words), list(words.values())
        for at in range(0, len(keys), 100_000):
            some = keys[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([of(len(some)), pa.array(some, pa.binary()), nothing(len(some), pa.int64()),
                                              pa.array(counts[at:at + 100_000], pa.int64())], schema=LOCAL)
        words.clear()
        grams.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for mine, held, packed in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                if mine != chunk:
                    yield from flush()
                    chunk = mine
                text = unpack(packed)
                found = text.split()
                if held:
                    words.update(dict.fromkeys([*found, END], 0))
                else:
                    words.update(found)
                    words[END] += 1
                waiting.append((text, held))
                size += len(text)
                if size > GRAM_BLOCK:
                    fold()
                    size = 0
    yield from flush()


def log_probabilities(grams: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
    """log10 P of each gram (rows gram, n; contexts all end in the same two bytes) in the trie.

    ``first``: 256 x 256 training counts of byte pairs, which give the orders 1 and 0. T is the log probability of a
    byte after an escape from a context into the next shorter one, S that of starting in the context."""
    codes, n = grams["gram"].to_numpy(), grams["n"].to_numpy().astype(float)
    byte, last = codes & 255, int(codes[0] >> 8) & 255
    levels = []  # by order 0..ORDER, per row: count of the gram, and of its context: n, d, E (mass of its bytes one order down)
    root = first.sum(0)
    levels.append((root[byte], root.sum(), (root > 0).sum(), None))
    levels.append((first[last][byte], first[last].sum(), (first[last] > 0).sum(), root[first[last] > 0].sum()))
    for k in range(2, ORDER + 1):
        keys, at = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(at, n)
        context, own = np.unique(keys >> 8, return_inverse=True)
        below = np.empty(len(keys))
        below[at] = levels[k - 1][0]
        seen = count > 0
        stats = [np.bincount(own, v, len(context))[own][at] for v in (count, seen, below * seen)]
        levels.append((count[at], *stats))
    with np.errstate(divide="ignore", invalid="ignore"):
        total, distinct = levels[0][1], levels[0][2]
        lower = np.full(len(codes), -np.log10(max(256 - distinct, 1)))  # order -1: bytes the root never saw
        start = -np.log10(256.0) if not total else np.where(levels[0][0] > 0, np.log10(levels[0][0] / (total + distinct)),
                                                            np.log10(distinct / (total + distinct)) + lower)
        start, escaped = np.broadcast_to(start, len(codes)), lower
        for k in range(1, ORDER + 1):
            (down, n_down, d_down, _), (count, n_here, d_here, mass) = levels[k - 1], levels[k]
            room = n_down - mass + d_down - d_here
            # a shorter context without further bytes has nothing left to offer: it is passed for free
            onward = np.where(room > 0, np.log10((d_down - d_here) / np.where(room > 0, room, 1)), 0.0) + escaped
            escaped = np.where(down > 0, np.log10(down / np.where(room > 0, room, 1)), onward)
            own = np.where(count > 0, np.log10(count / (n_here + d_here)), np.log10(d_here / (n_here + d_here)) + escaped)
            start = np.where(np.asarray(n_here) > 0, own, start)
    return pd.DataFrame({"gram": codes, "logp": start})


def gram_model(counts: DataFrame) -> DataFrame:
    """(gram, logp) of every gram of ``counts`` (gram, n); n is 0 for grams of held-out texts only."""
    pairs = counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # 2**16 rows at most
    first = np.bincount(pairs["pair"].to_numpy(), pairs["n"].to_numpy().astype(float), 1 << 16).reshape(256, 256)
    tail = F.shiftright(F.col("gram"), 8).bitwiseAND(F.lit(0xFFFF))
    return counts.groupBy(tail.alias("tail")).applyInPandas(
        lambda group: log_probabilities(group, first), "gram long, logp double")


def score_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, kind): words with their counts (kind 0; 1 in the first chunk that holds the word), grams with
    their log10 P (2), then the texts (3, held out 4). How many known words a task was the first to hold leaves in a
    row of its own."""
    unpack = zstandard.ZstdDecompressor().decompress
    chunk, words, codes, logs, table, texts = None, {}, [], [], None, []
    distinct = 0

    def score() -> pa.RecordBatch:
        grams, sizes = gram_codes([t for _, _, t in texts])
        totals = np.add.reduceat(table[1][np.searchsorted(table[0], grams)], np.cumsum(sizes) - sizes)
        rows = []
        for (ident, held, text), total in zip(texts, totals.tolist()):
            counts = np.array([words[w] for w in text.split()] + [words[END]], float)
            rows.append((ident, held, len(counts), int((counts > 0).sum()), float(np.log10(counts + ALPHA).sum()), total, 0,
                         0 if held else len(counts)))
        texts.clear()
        return record(rows, SCORED)

    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            for mine, kind, key, number, value in zip(*(c.to_pylist() for c in batch.slice(at, 5000).columns)):
                if mine != chunk:
                    if texts:
                        yield score()
                    chunk, words, codes, logs, table, size = mine, {}, [], [], None, 0
                if kind <= 1:
                    words[key] = number
                    distinct += kind == 1 and number > 0
                elif kind == 2:
                    codes.append(number)
                    logs.append(value)
                else:
                    if table is None:
                        order = np.argsort(np.array(codes, np.int64), kind="stable")
                        table = np.array(codes, np.int64)[order], np.array(logs)[order]
                        codes, logs = [], []
                    text = unpack(key)
                    texts.append((number, kind == 4, text))
                    size += len(text)
                    if size > GRAM_BLOCK:
                        yield score()
                        size = 0
    if texts:
        yield score()
    if distinct:
        yield record([(None, None, None, None, None, None, int(distinct), 0)], SCORED)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
                          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out`` (fold 0, not learnt from), ``n_tokens`` (words and one end), ``n_known``
    (tokens seen in training), ``train_tokens``, ``base_score`` (unigram, add 0.1) and ``score`` (PPM), both log10.

    Null and empty texts have one token, their end. Rows without an id count as id text '' for the
    fold. Repeated rows are learnt from as often as they occur. Without training texts, every byte has
    probability 1/256. An empty table gives an empty result."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, folds).alias("held"),
                       F.col(text_col).cast("string").alias("text"))
    texts = materialize(base.mapInArrow(pack_chunks(chunk_bytes), ddl(PACKED)), "lm-texts")
    local = materialize(texts.select("chunk", "held", "packed").mapInArrow(count_chunks, ddl(LOCAL)), "lm-counts")
    # a word has one row per chunk at most: its corpus count is a sum over few rows, however frequent it is
    same = Window.partitionBy("word")
    words = local.where("word IS NOT NULL").select(
        "chunk", (F.row_number().over(same.orderBy("chunk")) == 1).cast("int").alias("kind"), F.col("word").alias("key"),
        F.sum("n").over(same).alias("number"), F.lit(None).cast("double").alias("value"))
    grams = local.where("gram IS NOT NULL")
    model = gram_model(materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams"))
    wanted = grams.join(model, "gram").select("chunk", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("key"),
                                              F.col("gram").alias("number"), F.col("logp").alias("value"))
    rows = texts.select("chunk", F.when(F.col("held"), 4).otherwise(3).alias("kind"), F.col("packed").alias("key"),
                        F.col("id").alias("number"), F.lit(None).cast("double").alias("value"))
    dealt = words.unionByName(wanted).unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "kind")
    scored = materialize(dealt.mapInArrow(score_chunks, ddl(SCORED)), "lm-scores")
    totals = scored.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    share = float(np.log10(totals.n + ALPHA * (totals.v + 1)))
    return scored.where("n_tokens IS NOT NULL").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(share)).alias("base_score"), "score")
