"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in Arrow batches (byte histograms and word counts). The
trees are fitted on a bounded sample of labelled rows: features are cut into at most 64
bins, each level of a tree is grown from histograms of gradients, and the trees end up as flat
arrays of complete binary trees. Scoring walks all rows of a batch down a tree at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, held_out, materialize

FOLDS = 5
THRESHOLD = 0.3
SAMPLE_ROWS = 60_000  # bound on the labelled rows that the trees are fitted on
BINS = 64

GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"()-",
          b"#$%&*@^~", b"|<>{}[]\\/_=+`", b" ", b"\n", b"\t\r\x0b\x0c", bytes(range(128, 256))]
MEMBER = np.array([[b in g for g in GROUPS] for b in range(256)], float)
FEATURES = [*(f"share_{i}" for i in range(len(GROUPS))), "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words",
            "top_word", "repeats_next", "bytes_used", "byte_entropy", "log_lines", "distinct_lines", "line_bytes", "short_words"]


def statistics(text: str) -> tuple[list[float], np.ndarray]:
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m, size = max(len(words), 1), max(len(lines), 1), max(len(raw), 1)
    tally = Counter(words)
    share = counts[counts > 0] / size
    return [np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(max(map(len, tally), default=0)),
            len(tally) / n, max(tally.values(), default=0) / n, sum(a == b for a, b in pairwise(words)) / n,
            len(share), -float(share @ np.log2(share)) if len(share) else 0.0, np.log1p(len(lines)), len(set(lines)) / m,
            np.log1p(sum(map(len, lines)) / m), sum(c for w, c in tally.items() if len(w) <= 3) / n], counts


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text; null texts count as empty."""
    found = [statistics(t or "") for t in texts]
    counts = np.array([c for _, c in found], float).reshape(-1, 256)
    shares = counts @ MEMBER / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.hstack([shares, np.array([f for f, _ in found], float).reshape(len(found), -1)])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node i has children 2i+1 and 2i+2; a row goes right if its value is over the cut."""
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        depth, rows = self.leaf.shape[1].bit_length() - 1, np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def bin_cuts(x: np.ndarray) -> list[np.ndarray]:
    """Cut points per feature: midpoints of at most BINS - 1 distinct quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.1, l2: float = 1.0,
              least: float = 2.0) -> Trees:
    """Logistic boosting with second-order leaves. ``least``: smallest hessian sum of a child. Labels of
    one kind only, or no rows, give the constant model of their (smoothed) share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, f = 2**depth - 1, x.shape[1]
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return Trees(feature, cut, leaf, start)
    cuts = bin_cuts(x)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    slots, total = binned + BINS * np.arange(f), np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (f * BINS) + slots).ravel()
            tall = lambda v: np.bincount(at, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS).cumsum(2)
            left_g, left_h = tall(g), tall(h)
            sum_g, sum_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = sum_g - left_g, sum_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - sum_g**2 / (sum_h + l2)
            gain[(left_h < least) | (right_h < least)] = 0
            gain = gain.reshape(width, -1)
            best = gain.argmax(1)
            useful = gain[np.arange(width), best] > 1e-6
            split_f, split_b = best // BINS, best % BINS
            for i in np.flatnonzero(useful):
                feature[t, first + i], cut[t, first + i] = split_f[i], cuts[split_f[i]][split_b[i]]
            own = node - first
            right = useful[own] & (binned[np.arange(len(y)), split_f[own]] > split_b[own])
            node = 2 * node + 1 + right
        own = node - inner
        leaf[t] = -rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + l2)
        total += leaf[t][own]
    return Trees(feature, cut, leaf, start)


def statistics_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = [features(batch.column(1).slice(at, 500).to_pylist()) for at in range(0, batch.num_rows, 500)]
    flat = np.vstack(parts).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], np.int32)), pa.array(flat.ravel()))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "x"])


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, x array<float> in the order of ``FEATURES``) for every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(by_batch(statistics_batch), "id long, x array<float>")


def label_sample(labels: DataFrame, id_col: str, label_col: str, folds: int, sample_rows: int) -> DataFrame:
    """(id, y) of at most ``sample_rows`` labelled ids (those of smallest hash) outside fold 0. Several labels of one id
    count as their largest; null labels and ids don't count."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds)) \
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    return known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``sample_rows`` rows: one for each id of ``label_sample``, the least statistics if the
    id stands on several rows (reduced where they lie, before anything is gathered)."""
    sample = label_sample(labels, id_col, label_col, folds, sample_rows)
    rows = stats.join(sample, "id").groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y")).toArrow()
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))[order].astype(float)
    return fit_trees(x, rows["y"].to_numpy()[order].astype(float))


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """``fit`` for documents whose statistics are not needed otherwise: only the sample's are computed."""
    sample = materialize(label_sample(labels, id_col, label_col, folds, sample_rows), "label-sample")
    known = docs.join(sample.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return fit(document_statistics(known, id_col, text_col), labels, id_col, label_col, folds, sample_rows)


def score_batch(model: Trees):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])
    return run


def score_column(model: Trees, text: Column) -> Column:
    """Score of a text column, for filtering rows in place."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.vstack([features(texts[at:at + 500].tolist()) for at in range(0, len(texts), 500)]) if len(texts) else None
            yield pd.Series(model.score(x.astype(np.float32).astype(float)) if len(texts) else np.empty(0))
    return scored(text)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
            folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out`` (fold 0, never learnt from), ``score`` (0 to 1, higher: label 1
    likelier), ``predicted`` (1 if the score reaches ``threshold``).

    Null and empty texts have statistics of zero and get the score of those. Rows without an id count
    as id text '' for the fold; repeated rows score alike; without labels every score is the constant
    one half; an empty table gives an empty result."""
    stats = materialize(document_statistics(docs, id_col, text_col), "document-statistics")
    model = fit(stats, labels, id_col, label_col, folds)
    scored = stats.mapInArrow(by_batch(score_batch(model)), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id", folds).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is under ``threshold``; columns unchanged, texts not shuffled."""
    return docs.where(score_column(model, F.col(text_col).cast("string")) >= threshold)
