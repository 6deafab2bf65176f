"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's features are its distinct words and their first 4, 5 and 6 letters, hashed, each word
counting 1 + ln(occurrences); one weight per feature, shared by all thresholds: P(grade >= j) = sigmoid(s - t_j) with t_1 < t_2 < ...
Weights are never negative, so clean text around a few toxic words cannot outweigh them. The expected severity is the sum of these probabilities. A document's sum is additive over its
distinct words, so scoring looks each word up in a bounded memo.

Labels say toxic or not. Grades are made from them: 0 for clean documents, and for toxic ones 1, 2 or
3 by how many distinct marker words they hold; markers are words whose stem is far commoner in toxic than in clean
documents of the sample. A label column that holds grades already is used as it is.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, materialize

SAMPLE_ROWS = 12_000  # bound on the labelled rows that the weights are fitted on
SAMPLE_BYTES = 200_000  # longer texts are scored like all others, but not fitted on
PREFIXES = (4, 5, 6)
GRADE_STEPS = (3, 6)  # distinct markers from which a toxic document has grade 2 and 3
MEMO_WORDS = 400_000
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_"


def words_of(text: str) -> dict[str, float]:
    """Distinct words in lower case without punctuation at their ends: 1 + ln of the occurrences of each.
    Spellings that differ in punctuation only add up."""
    found: dict[str, float] = {}
    for spelling, n in Counter(text.lower().split()).items():
        if word := spelling.strip(EDGES):
            found[word] = found.get(word, 0) + n
    return {w: 1 + math.log(n) if n > 1 else 1.0 for w, n in found.items()}


def word_features(word: str) -> list[int]:
    """Hashes of the whole word and of its stems."""
    return [zlib.crc32(f"{n}:{word[:n]}".encode()) for n in PREFIXES if len(word) > n] + [zlib.crc32(f"w:{word}".encode())]


@dataclass
class Severity:
    weights: dict[int, float]
    thresholds: np.ndarray
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "thresholds": self.thresholds, "memo": {}}

    def word(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            got = self.memo[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return got

    def sums(self, texts: list[str | None]) -> np.ndarray:
        return np.array([math.fsum(v * self.word(w) for w, v in words_of(t or "").items()) for t in texts], float)

    def at_least(self, sums: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ...: one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - sums[:, None], -500, 500)))


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, grades: np.ndarray, levels: int, width: int, rounds: int = 300,
                l1: float = 1e-4, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (not negative) and ascending thresholds by proximal AdaGrad on the mean log loss, L1 penalty.

    ``rows``/``columns``/``values``: cells of the sparse n x width matrix; ``grades``: 0 to levels-1."""
    share = np.array([(np.sum(grades < j) + 0.5) / (n + 1) for j in range(1, levels)])
    first, steps = np.log(share[0] / (1 - share[0])), np.diff(np.log(share / (1 - share)))
    free = np.concatenate([[first], np.log(np.maximum(steps, 0.1))])  # t_1 and the logs of the gaps
    w, seen, seen_t = np.zeros(width), np.full(width, 1e-8), np.full(levels - 1, 1e-8)
    for _ in range(rounds):
        gaps = np.exp(free[1:])
        t = np.concatenate([[-np.inf], free[0] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(rows, w[columns] * values, n)
        upper, lower = sigmoid(t[grades + 1] - s), sigmoid(t[grades] - s)
        p = np.maximum(upper - lower, 1e-12)
        grad_w = np.bincount(columns, (1 - upper - lower)[rows] * values, width) / n
        each = np.zeros(levels + 1)
        np.add.at(each, grades + 1, -upper * (1 - upper) / p)
        np.add.at(each, grades, lower * (1 - lower) / p)
        inner = each[1:-1] / n  # gradient by threshold
        below = np.cumsum(inner[::-1])[::-1]
        grad_t = np.concatenate([[below[0]], below[1:] * gaps])
        seen += grad_w**2
        seen_t += grad_t**2
        step = rate / np.sqrt(seen)
        w = np.maximum(w - step * (grad_w + l1), 0)
        free -= rate / np.sqrt(seen_t) * grad_t
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def severity_grades(texts: list[str | None], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3: toxic documents by their number of distinct marker words. A stem is a marker if it is
    in at least 3 toxic documents and 20 times as common in toxic as in clean ones."""
    tallies = [Counter(), Counter()]
    stem = lambda w: w[:PREFIXES[0]]
    for text, t in zip(texts, toxic):
        tallies[int(t > 0)].update({stem(w) for w in words_of(text or "")})
    clean, bad = max(int((toxic == 0).sum()), 1), max(int((toxic > 0).sum()), 1)
    markers = {s for s, c in tallies[1].items() if c >= 3 and c / bad > 20 * tallies[0][s] / clean}
    count = np.array([sum(stem(w) in markers for w in words_of(text or "")) if t else 0 for text, t in zip(texts, toxic)])
    return np.where(toxic == 0, 0, 1 + sum((count >= c).astype(int) for c in GRADE_STEPS))


def fit_sample(texts: list[str | None], labels: np.ndarray) -> Severity:
    """Severity model of a bounded sample. Labels 0/1 become grades; larger labels are grades already.
    Labels of one kind give no weights."""
    grades = (severity_grades(texts, labels) if labels.max(initial=0) <= 1 else labels).astype(int)
    levels = int(max(grades.max(initial=0) + 1, 2))
    if len(set(grades.tolist())) < 2:
        share = (np.sum(grades > 0) + 0.5) / (len(grades) + 1)
        return Severity({}, np.log((1 - share) / share) + np.arange(levels - 1))
    hashed, weighed = [], []
    for text in texts:
        cells: dict[int, float] = {}
        for w, v in words_of(text or "").items():
            for f in word_features(w):
                cells[f] = cells.get(f, 0.0) + v
        hashed.append(np.fromiter(cells, np.uint32, len(cells)))
        weighed.append(np.fromiter(cells.values(), np.float32, len(cells)))
    sizes = np.array([len(h) for h in hashed])
    flat = np.concatenate(hashed)
    keep = screened(flat, np.repeat(grades > 0, sizes), grades)
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[keep]
    ids, columns = np.unique(flat[keep], return_inverse=True)
    w, thresholds = fit_ordinal(rows, columns, np.concatenate(weighed)[keep], len(grades), grades, levels, len(ids))
    return Severity({int(f): float(v) for f, v in zip(ids[w > 0], w[w > 0])}, thresholds)


def screened(flat: np.ndarray, bad: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """True for features worth a weight: in at least 5 documents of grade 1 or more, and 4 times as common there
    as in others (with fewer, chance alone sets some of the many rare words apart)."""
    slot = flat & np.uint32((1 << 22) - 1)
    toxic, clean = np.bincount(slot[bad], minlength=1 << 22), np.bincount(slot[~bad], minlength=1 << 22)
    share = max(int((grades > 0).sum()), 1) / max(int((grades == 0).sum()), 1)
    return ((toxic >= 5) & (toxic >= 4 * share * clean))[slot]


def fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits the whole (bounded) sample in one task and returns the weights and thresholds as rows."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    model = fit_sample([t for _, t, _ in rows], np.array([y for _, _, y in rows], int))
    cells = [("w", f, v) for f, v in model.weights.items()] + [("t", i, float(v)) for i, v in enumerate(model.thresholds)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], ["kind", "at", "value"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Severity:
    """Model fitted on at most ``sample_rows`` labelled rows, in one task: those of smallest hashed id, one row an id (the text of
    smallest hash if the id stands on several, reduced where the rows lie) of at most SAMPLE_BYTES.

    Several labels of one id count as their largest; null labels and ids don't count. The weights are
    few (L1), bounded by the sample, and travel with the scoring function."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = materialize(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "label-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    one = texts.join(sample, "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    cells = one.select("id", "text", "y").repartition(1).mapInArrow(fit_task, "kind string, at long, value double") \
        .toArrow().to_pylist()
    weights = {c["at"]: c["value"] for c in cells if c["kind"] == "w"}
    thresholds = [c["value"] for c in sorted(cells, key=lambda c: c["at"]) if c["kind"] == "t"]
    return Severity(weights, np.array(thresholds or [0.0]))


def score_batch(model: Severity):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = np.concatenate([model.sums(batch.column(1).slice(at, 500).to_pylist()) for at in range(0, batch.num_rows, 500)])
        p = model.at_least(sums)
        arrays = [batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["id", "severity", "p_toxic", "grade"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``severity`` (expected grade), ``p_toxic`` (P(grade >= 1)), ``grade`` (thresholds
    passed with probability one half or more) and ``toxic`` (grade of 1 or more).

    Null and empty texts have no features and get the severity of the intercept alone. Rows without an id
    are scored; repeated rows score alike; without labels p_toxic is one half for all; an
    empty table gives an empty result."""
    model = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(by_batch(score_batch(model)), "id long, severity double, p_toxic double, grade int")
    return scored.select(F.col("id").alias(id_col), "severity", "p_toxic", "grade", (F.col("grade") >= 1).alias("toxic"))


def severity_column(model: Severity, text: Column) -> Column:
    """P(grade >= 1) of a text column, for filtering rows in place."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.at_least(model.sums(texts.tolist()))[:, 0])
    return scored(text)


def drop_toxic(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of grade 1 or more; columns unchanged, texts not shuffled."""
    return docs.where(severity_column(model, F.col(text_col).cast("string")) < 0.5)
