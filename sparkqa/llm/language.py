"""Language identification by hierarchical discrimination.

A first layer of linear support vector machines (one against the rest) predicts the language family; inside the
family, one-versus-one machines separate the closely related languages, and the language with most duels won is taken.

Features are hashed runs of one to four characters of the lower-cased text, every run of other characters than letters
standing for a word boundary. The machines have no intercept, so a text's decision values are plain sums of one weight a character run:
whole texts are scored by table look-ups over flat character arrays, in pieces of bounded length.

The machines are fitted by dual coordinate descent on a bounded sample of distinct texts, the same number of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, held_out, materialize

FOLDS = 5
SAMPLE_ROWS = 6_000  # bound on the distinct texts that the machines are fitted on
SAMPLE_CELLS = 768  # bound on the features (the most frequent) that a text of the sample brings
MOST_LANGUAGES = 32  # bound on the languages learnt: those of most distinct texts
SLOT_BITS = 16
RUNS = (1, 2, 3, 4)  # lengths of character runs
PIECE = 1 << 18  # characters scored at once
UNDETERMINED = "und"

#: Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "iranian": "fa ku ps tg",
    "indic": "bn gu hi mr ne pa sa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg mi ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """Family of a language code; region and script after a hyphen or underscore don't count."""
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def character_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; 0 where there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letter_table()[codes], codes, np.uint32(0))


def pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, codes) of pieces of about PIECE characters: runs that start before a piece's last three codes are the
    piece's own, so every run of a text starts in exactly one piece. Three boundaries stand at both ends of a text."""
    ahead, edge = RUNS[-1] - 1, np.zeros(RUNS[-1] - 1, np.uint32)
    for n, text in enumerate(texts):
        # lower-casing piece by piece keeps long texts cheap; the codes that overlap are the same ones
        left = edge
        for at in range(0, len(text or ""), PIECE):
            codes = character_codes(text[at:at + PIECE])
            if len(left) + len(codes) > ahead:
                yield n, np.concatenate([left, codes])
                left = np.concatenate([left, codes])[-ahead:]
        if text:
            yield n, np.concatenate([left, edge])


def slots(codes: np.ndarray, run: int) -> np.ndarray:
    """Hashed slot of the run of ``run`` characters that starts at each position with three codes after it."""
    count = max(len(codes) - RUNS[-1] + 1, 0)
    mixed = np.full(count, run, np.uint32)
    for i in range(run):
        mixed = (mixed ^ codes[i:i + count]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed * np.uint32(0x85EBCA6B) >> np.uint32(32 - SLOT_BITS)


@lru_cache(maxsize=1)
def empty_slots() -> list[int]:
    """Slots of runs without a letter: they say nothing."""
    return [int(slots(np.zeros(RUNS[-1], np.uint32), run)[0]) for run in RUNS]


def text_cells(text: str | None, most: int = SAMPLE_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the ``most`` commonest features of a text."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for _, codes in pieces([text]):
        for run in RUNS:
            total += np.bincount(slots(codes, run), minlength=len(total))
    total[empty_slots()] = 0
    found = np.flatnonzero(total)
    found = np.sort(found[np.argsort(-total[found], kind="stable")[:most]])
    return found.astype(np.uint16), total[found].astype(np.float32)


Cells = list[tuple[np.ndarray, np.ndarray]]


def fit_machine(cells: Cells, side: np.ndarray, width: int, cost: float = 10.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, no intercept) by dual coordinate descent. Rows are
    ``cells`` of unit length; ``side`` is 1 or -1, and both sides weigh the same in all."""
    w, n = np.zeros(width), len(cells)
    share = np.where(side > 0, n / (2 * max((side > 0).sum(), 1)), n / (2 * max((side < 0).sum(), 1)))
    diagonal, alpha, random = 0.5 / (cost * share), np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(n):
            at, x = cells[i]
            slope = side[i] * float(x @ w[at]) - 1 + diagonal[i] * alpha[i]
            if alpha[i] > 0 or slope < 0:
                new = max(alpha[i] - slope / (1 + diagonal[i]), 0.0)
                w[at] += (new - alpha[i]) * side[i] * x
                alpha[i] = new
    return w


@dataclass
class Languages:
    """``weights``: one row per slot, one column per family (if several) and then one per pair of languages of a family."""
    names: list[str]
    families: list[str]  # of each language
    weights: np.ndarray
    scale: float = 1.0

    def __post_init__(self) -> None:
        self.groups = sorted(set(self.families))
        self.pairs = [(i, j) for i, j in combinations(range(len(self.names)), 2) if self.families[i] == self.families[j]]
        self.top = len(self.groups) if len(self.groups) > 1 else 0

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(decision sums, positions scored, letters) of each text, over the whole of it."""
        total, size, letters = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held, owners, length = [], [], 0

        def flush() -> None:
            codes, ahead = np.concatenate(held), RUNS[-1] - 1
            ends = np.cumsum([len(c) for c in held])
            # positions with all codes after them inside the same piece; those between are no piece's
            marks = np.stack([ends - [len(c) for c in held], np.minimum(ends - ahead, max(len(codes) - ahead, 0))], 1)
            scored = self.weights[slots(codes, RUNS[0])]
            for run in RUNS[1:]:
                scored += self.weights[slots(codes, run)]
            inside = np.repeat(np.arange(len(held)), marks[:, 1] - marks[:, 0])
            rows = np.concatenate([np.arange(a, b) for a, b in marks])
            for k in range(scored.shape[1]):
                np.add.at(total[:, k], owners, np.bincount(inside, scored[rows, k], len(held)))
            np.add.at(size, owners, marks[:, 1] - marks[:, 0])
            np.add.at(letters, owners, np.bincount(inside, codes[rows] > 0, len(held)).astype(np.int64))

        for owner, codes in pieces(texts):
            held.append(codes)
            owners.append(owner)
            length += len(codes)
            if length >= PIECE:
                flush()
                held, owners, length = [], [], 0
        if held:
            flush()
        return total, size, letters

    def confident(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Decision sums as values of a logistic function: a sum grows with the length of a text, its noise with the root."""
        return total * (self.scale / np.sqrt(np.maximum(size, 1)))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        total, size, letters = self.sums(texts)
        value = self.confident(total, size)
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, scores
        if self.top:
            group = value[:, :self.top].argmax(1)
            shares = np.exp(value[:, :self.top] - value[:, :self.top].max(1, keepdims=True))
            sure = shares.max(1) / shares.sum(1)
        else:
            group, sure = np.zeros(len(texts), int), np.ones(len(texts))
        for g, name in enumerate(self.groups):
            rows = np.flatnonzero((group == g) & (letters > 0))
            members = [i for i, f in enumerate(self.families) if f == name]
            won, margin, least = (np.zeros((len(rows), len(self.names))) for _ in range(3))
            least += np.inf
            for k, (i, j) in enumerate(self.pairs):
                if i in members:
                    duel = value[rows, self.top + k]
                    for lang, v in ((i, duel), (j, -duel)):
                        won[:, lang] += (v > 0) | ((v == 0) & (lang == i))
                        margin[:, lang] += v
                        least[:, lang] = np.minimum(least[:, lang], v)
            # most duels won; among equals the larger margin, then the first name
            order = np.lexsort((np.broadcast_to(-np.arange(len(members)), (len(rows), len(members))), margin[:, members], won[:, members]), axis=1)
            best = np.array(members)[order[:, -1]]
            scores[rows] = sure[rows] / (1 + np.exp(-np.clip(least[np.arange(len(rows)), best], -500, 500)))
            for r, b in zip(rows, best):
                names[r] = self.names[b]
        return names, scores


def fit_languages(cells: Cells, langs: list[str]) -> Languages:
    """Family and pair machines of a bounded sample. Features are scaled by the root of how often the sample has them, so
    that common ones don't decide alone; the scale goes into the weights. No rows: no language; one language: no machine."""
    names = sorted(set(langs))
    families = [family_of(n) for n in names]
    width, groups = 1 << SLOT_BITS, sorted(set(families))
    often = np.zeros(width)
    for at, count in cells:
        often[at] += count / count.sum()
    scale = 1 / np.sqrt(often + 1e-3 * max(len(cells), 1) / width + 1e-12)
    unit = []
    for at, count in cells:
        x = count * scale[at]
        unit.append((at, x / np.sqrt(x @ x)))
    own = np.array([names.index(x) for x in langs], int)
    family = np.array([groups.index(f) for f in families], int)[own] if names else own
    columns = [fit_machine(unit, np.where(family == g, 1, -1), width) for g in range(len(groups))] if len(groups) > 1 else []
    for i, j in combinations(range(len(names)), 2):
        if families[i] == families[j]:
            rows = np.flatnonzero((own == i) | (own == j))
            columns.append(fit_machine([unit[r] for r in rows], np.where(own[rows] == i, 1, -1), width))
    weights = np.stack(columns, 1) * scale[:, None] if columns else np.zeros((width, 0))
    weights[empty_slots()] = 0
    # one common scale: the median text of the sample gets a logistic value of 6 from its largest decision
    values = [np.abs(count @ weights[at]).max() / np.sqrt(count.sum() / len(RUNS)) for at, count in cells] if columns else []
    return Languages(names, families, weights.astype(np.float32), 6 / max(float(np.median(values)), 1e-9) if values else 1.0)


def cells_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [text_cells(t) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("mix"), pa.array([a.tobytes() for a, _ in found], pa.binary()),
                                       pa.array([c.tobytes() for _, c in found], pa.binary())], ["lang", "mix", "at", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS,
        sample_rows: int = SAMPLE_ROWS, languages: int = MOST_LANGUAGES) -> Languages:
    """Machines fitted on at most ``sample_rows`` distinct texts with a letter outside fold 0: of each of the ``languages`` commonest
    languages (by distinct texts) the same number, those of smallest hash. Copies and repeated ids count once a language, and only the sample's
    sparse features reach the driver: at most SAMPLE_CELLS of 6 bytes a text."""
    text = F.col(text_col).cast("string")
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col, folds)) \
        .select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("mix")).where(F.col("text").rlike(r"\p{L}"))
    distinct = materialize(known.select("lang", "mix").distinct(), "language-texts")
    common = distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    each = sample_rows // max(len(common), 1)
    # hashes are even: the smallest 2 * each + 100 of n lie below about that share of the range, so few rows are ranked
    low = F.lit(False)
    for r in common:
        low = low | ((F.col("lang") == r.lang) & (F.col("mix") <= min(int((2 * each + 100) / r["count"] * 2**64), 2**64 - 1) - 2**63))
    sample = distinct.where(low).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("mix"))).where(F.col("rank") <= each).select("lang", "mix")
    sample = materialize(sample, "language-sample")
    # one row a text before anything is gathered: copies give the same features
    cells = known.join(sample, ["lang", "mix"]).groupBy("lang", "mix").agg(F.any_value("text").alias("text")) \
        .mapInArrow(by_batch(cells_batch), "lang string, mix long, at binary, n binary")
    rows = sorted(cells.toArrow().to_pylist(), key=lambda r: (r["lang"], r["mix"]))
    rows = [r for r in rows if r["at"]]
    return fit_languages([(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.float32)) for r in rows], [r["lang"] for r in rows])


def predict_batch(model: Languages):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = [], []
        for at in range(0, batch.num_rows, 500):
            names, found = model.predict(batch.column(1).slice(at, 500).to_pylist())
            langs += names
            scores.append(found)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["id", "lang_pred", "score"])
    return run


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out`` (fold 0, never learnt from), ``lang_pred``, ``score`` (0 to 1: how sure).

    Texts that are null or have no letter get ``und`` with score 0, and so does every text if no language is known. Whole texts count,
    long ones piece by piece in bounded memory. Rows without an id count as id text '' for the fold; repeated rows
    get the same prediction; equal decisions go to the first name; other columns, whatever their names, are not read; an
    empty table gives an empty result."""
    model = fit(docs, id_col, text_col, lang_col, folds, sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(by_batch(predict_batch(model)), schema).select(
        F.col("id").alias(id_col), held_out("id", folds).alias("held_out"), "lang_pred", "score")


def language_column(model: Languages, text: Column) -> Column:
    """Predicted language of a text column, for filtering rows in place."""
    @F.pandas_udf("string")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([name for at in range(0, len(texts), 500) for name in model.predict(texts[at:at + 500].tolist())[0]], dtype=object)
    return predicted(text)
