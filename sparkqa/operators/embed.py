"""Text -> vector column (op 12).

The reference sends titles to a hosted embedding model. Here any batch embedder can be
plugged in (run through an iterator pandas UDF, so a model loads once per task and sees
Arrow batches); the offline default is a feature-hashing embedder written with native
expressions: lower-case words of the whole text, bucket = first 8 hex digits of md5 mod
``dim``, counts per bucket, L2-normalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import spread

DEFAULT_DIM = 64


def token_buckets(text: str | Column, dim: int = DEFAULT_DIM) -> Column:
    """Bucket number of every word of the text."""
    return F.transform(
        tokens(text),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


COUNT_ROWS = 256             # texts counted at once, so a batch of long texts is never held as numbers whole


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit_bincount(buckets: pd.Series, dim: pd.Series) -> pd.Series:
    """Bucket histograms of a block of an Arrow batch with one ``bincount`` (row offsets added to
    the bucket ids), then L2-normalised rows."""
    n = int(dim.iloc[0]) if len(dim) else DEFAULT_DIM
    out: list[np.ndarray | None] = [None] * len(buckets)
    valid = np.flatnonzero(buckets.notna().to_numpy())
    for at in range(0, len(valid), COUNT_ROWS):
        block = valid[at:at + COUNT_ROWS]
        arrs = [buckets.iloc[i] for i in block]
        ids = np.repeat(np.arange(len(block), dtype=np.int64) * n, [len(a) for a in arrs]) + np.concatenate(arrs).astype(np.int64)
        counts = np.bincount(ids, minlength=len(block) * n).astype(np.float64).reshape(len(block), n)
        norms = np.sqrt(np.sum(counts * counts, axis=1))
        unit = np.divide(counts, norms[:, None], out=counts.copy(), where=norms[:, None] > 0)
        for j, i in enumerate(block):
            out[i] = unit[j]
    return pd.Series(out)


def word_buckets(words: pa.Array, dim: int) -> np.ndarray:
    """``token_buckets`` of an array of words, each distinct word hashed once."""
    distinct = words.dictionary_encode()
    digests = b"".join(md5(w, usedforsecurity=False).digest()[:4] for w in distinct.dictionary.cast(pa.binary()).to_pylist())
    return (np.frombuffer(digests, ">u4").astype(np.int64) % dim)[distinct.indices.to_numpy()]


def unit_counts(words: pa.Array, dim: int) -> pa.Array:
    """Bucket histograms of lists of words, L2-normalised; no list, no vector."""
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    ends, ids = np.cumsum(sizes), word_buckets(words.flatten(), dim).astype(np.int16 if dim < 1 << 15 else np.int64)
    unit = np.zeros((len(sizes), dim))
    for at in range(0, len(sizes), COUNT_ROWS):
        n = sizes[at:at + COUNT_ROWS]
        first = np.repeat(np.arange(len(n), dtype=np.int64) * dim, n)
        counts = np.bincount(first + ids[ends[at] - n[0]:ends[at] - n[0] + n.sum()], minlength=len(n) * dim).astype(float).reshape(len(n), dim)
        norms = np.sqrt(np.sum(counts * counts, axis=1))
        np.divide(counts, norms[:, None], out=unit[at:at + COUNT_ROWS], where=norms[:, None] > 0)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype="int32") * dim), pa.array(unit.ravel()), mask=words.is_null())
    return lists


@cache
def _unit_counts(dim: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def count(words: pa.Array) -> pa.Array:
        return unit_counts(words, dim)
    # Marked nondeterministic so Catalyst never copies the call: a filter on the vector
    # (``vector IS NOT NULL``) would otherwise be pushed below the projection and the spread
    # repartition with the UDF inlined, embedding every text twice, once in the scan's tasks.
    return count.asNondeterministic()


def hashed_embedding(text: str | Column, dim: int = DEFAULT_DIM) -> Column:
    """Unit bucket-count vector: words are cut in the JVM; each distinct word of an Arrow batch is hashed once."""
    return _unit_counts(dim)(tokens(text))


def _model_udf(embedder: Callable[[list[str]], list], dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vecs = embedder(texts.fillna("").tolist())
            yield pd.Series([[float(x) for x in v] for v in vecs])
    return run.asNondeterministic()          # never copied by filter pushdown (see above)


def embed(df: DataFrame, text: str, dim: int = DEFAULT_DIM, embedder=None, out: str = "vector") -> DataFrame:
    """Add a vector column for ``text``. ``embedder(list_of_texts) -> list_of_vectors``."""
    df = spread(df)
    if embedder is None:
        return df.withColumn(out, hashed_embedding(text, dim))
    return df.withColumn(out, _model_udf(embedder, dim)(F.col(text)))


def bucket_table(df: DataFrame, key: str, text: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Long form (key, bucket, n) of the default embedder's counts, non-zero buckets only.
    The aggregate combines map-side: at most ``dim`` partial rows per document leave a task."""
    x = spread(df.select(key, text)).select(key, F.explode(token_buckets(text, dim)).alias("bucket"))
    return x.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
