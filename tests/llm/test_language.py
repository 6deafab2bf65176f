"""Held-out accuracy, sums against plain counting of character runs, machines, and awkward rows."""

import numpy as np
import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F

from edge import LONG, clashing, documents, empty, rows
from sparkqa.llm import language, registry
from sparkqa.session import table


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(table(spark, SF_CHECK, "documents"))


def test_query_and_held_out_accuracy(spark):
    docs = table(spark, SF_CHECK, "documents")
    got = registry.QUERIES["op11_language_hierarchy"](spark, SF_CHECK)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    found = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang == r.lang_pred for r in found if r.held_out]
    assert len(held) > 100 and np.mean(held) >= 0.99 and all(0 <= r.score <= 1 for r in found)


def test_sample_is_bounded_and_leaves_out_the_held_out_fold(spark):
    docs = table(spark, SF_CHECK, "documents")
    copies = docs.limit(1).withColumn("lang", F.lit("en")).crossJoin(spark.range(3000).select(F.col("id").alias("n"))).drop("n")
    seen = []
    original = language.fit_languages
    language.fit_languages = lambda cells, langs: seen.append((len(cells), sorted(set(langs)))) or original(cells, langs)
    try:
        language.fit(docs.unionByName(copies), sample_rows=80)
        language.fit(docs.where(language.held_out("doc_id", 5)))
    finally:
        language.fit_languages = original
    assert seen[0] == (80, ["de", "en", "es", "fr"])
    assert seen[1] == (0, [])


def plain_sums(model, text):
    """One look-up per position and run length, character by character."""
    letters = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    codes = np.array([0, 0, 0, *letters, 0, 0, 0], np.uint32)
    total = np.zeros(model.weights.shape[1])
    for at in range(len(codes) - 3):
        for run in language.RUNS:
            total += model.weights[language.slots(codes[at:at + 4], run)[0]]
    return total


def test_sums_cover_whole_texts(model):
    texts = ["Die Katze", "", None, "le chat, et le chien!", "x", "a" * 3000 + " und " * 50, "\t \n", "中文 text ñandú"]
    found, size, letters = model.sums(texts)
    for n, t in enumerate(texts):
        assert found[n] == pytest.approx(plain_sums(model, t) if t else 0, abs=1e-4)
        assert size[n] == (len(t) + 3 if t else 0)
    assert [x > 0 for x in letters] == [True, False, False, True, True, True, False, True]


def test_long_texts_score_like_one_piece(model, monkeypatch):
    text = "und die Straße, the end, que asta él. " * 400
    whole = model.sums([text, "kurz"])
    monkeypatch.setattr(language, "PIECE", 100)
    pieces = model.sums([text, "kurz"])
    for a, b in zip(whole, pieces):
        assert np.allclose(a, b, atol=1e-3)
    assert model.predict([LONG, text])[0] == [model.predict([t])[0][0] for t in (LONG, text)]


def test_machine_reaches_the_optimum_of_the_hinge():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = np.where(x @ rng.standard_normal(6) + 0.3 * rng.standard_normal(60) > 0, 1, -1)
    cells = [(np.arange(6, dtype=np.uint16), r) for r in x]
    w = language.fit_machine(cells, side, 6, cost=2.0, epochs=400)
    share = np.where(side > 0, 60 / (2 * (side > 0).sum()), 60 / (2 * (side < 0).sum()))

    def loss(v):
        return v @ v / 2 + (2.0 * share * np.maximum(0, 1 - side * (x @ v)) ** 2).sum()
    v = np.zeros(6)  # plain gradient descent
    for _ in range(20_000):
        v -= 0.002 * (v - 2 * x.T @ (2.0 * share * side * np.maximum(0, 1 - side * (x @ v))))
    assert loss(w) == pytest.approx(loss(v), rel=1e-6)


def test_families_and_duels():
    assert [language.family_of(x) for x in ("de", "en-GB", "pt_BR", "xx")] == ["germanic", "germanic", "romance", "xx"]
    texts = {"de": "der und die das ist", "en": "the and of this is", "nl": "het een van zijn en", "fr": "le la les des une", "es": "el los una que por"}
    cells, langs = zip(*[(language.text_cells(t + f" {n}"), k) for k, t in texts.items() for n in range(3)])
    m = language.fit_languages(list(cells), list(langs))
    assert m.top == 2 and len(m.pairs) == 4 and m.weights.shape == (1 << 16, 6)
    assert m.predict(list(texts.values()))[0] == list(texts)
    one = language.fit_languages(list(cells[:3]), ["de"] * 3)
    assert one.predict(["anything", "", None])[0] == ["de", "und", "und"]
    assert language.fit_languages([], []).predict(["words"])[0] == ["und"]


def test_edge_rows(spark):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise(F.col("lang")))
    got = language.languages(docs)
    assert got.count() == docs.count()
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 9)))
    for i in (3, 4, 5):
        assert by_id[i] == {("und", 0.0)}
    assert by_id[6] == by_id[7] and len(by_id[12]) == 1 and all(p in ("de", "en") for p, _ in by_id[14])
    clash = clashing(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise(F.col("lang"))) \
        .withColumns({c: F.lit("clash") for c in ("lang_pred", "n", "at", "mix_")})
    assert rows(language.languages(clash)) == rows(got)
    assert language.languages(empty(spark)).collect() == []
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_column_filters_in_place(spark, model):
    docs = table(spark, SF_CHECK, "documents")
    kept = docs.where(language.language_column(model, F.col("text")) == "fr")
    assert kept.columns == docs.columns and abs(kept.count() - docs.where("lang = 'fr'").count()) <= 5
