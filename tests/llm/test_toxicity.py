"""Ordinal fit against its definition, held-out accuracy, and awkward rows."""

import numpy as np
from conftest import SF_CHECK, SF_SMALL

from edge import clashing, documents, empty
from sparkqa.llm import registry, toxicity
from sparkqa.session import table


def test_accuracy_on_labels_kept_back(spark):
    docs, known = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    learnt = known.where("doc_id % 4 != 1")            # some 300 rows, 40 of them toxic, in four languages
    found = {r.doc_id: r for r in toxicity.toxicity(docs, learnt).collect()}
    back = [(r.toxic, found[r.doc_id]) for r in known.where("doc_id % 4 = 1").collect()]
    caught = [r.toxic for t, r in back if t]
    clean = [r.toxic for t, r in back if not t]
    assert len(caught) > 5 and sum(caught) >= 0.7 * len(caught)
    assert sum(clean) <= 0.01 * len(clean)
    for r in found.values():
        assert 0 <= r.p_toxic <= 1 and r.toxic == (r.grade >= 1) == (r.p_toxic >= 0.5)
        assert r.p_toxic <= r.severity + 1e-12


def test_query_returns_every_document(spark):
    assert registry.QUERIES["op8_ordinal_toxicity"](spark, SF_SMALL).count() == table(spark, SF_SMALL, "documents").count()


def test_thresholds_ascend_and_weights_order_the_grades():
    rng = np.random.default_rng(5)
    n = 600
    grades = rng.integers(0, 4, n)
    texts = []
    for g in grades:
        words = [f"plain{rng.integers(0, 40)}" for _ in range(20)] + [f"scum{rng.integers(0, 9)}x" for _ in range(2 * g)]
        texts.append(" ".join(words))
    model = toxicity.fit_sample(texts, grades)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    assert min(model.weights.values()) > 0
    p = model.at_least(model.sums(texts))
    assert (np.diff(p, axis=1) <= 0).all()
    severity = p.sum(1)
    assert (np.diff([severity[grades == g].mean() for g in range(4)]) > 0.3).all()
    assert ((p[:, 0] >= 0.5) == (grades > 0)).mean() > 0.97


def test_gradient_is_that_of_the_loss():
    """One step down the gradient from any point lowers the loss: fitted loss under that of the start."""
    rng = np.random.default_rng(0)
    rows, columns = np.nonzero(rng.random((80, 6)) < 0.4)
    grades = (np.bincount(rows, columns < 2, 80) + rng.integers(0, 2, 80)).astype(int).clip(0, 2)

    def loss(w, t):
        s = np.bincount(rows, w[columns], 80)
        cut = np.concatenate([[-np.inf], t, [np.inf]])
        return -np.log(toxicity.sigmoid(cut[grades + 1] - s) - toxicity.sigmoid(cut[grades] - s)).mean()

    def fit(n):
        return toxicity.fit_ordinal(rows, columns, np.ones(len(rows)), 80, grades, 3, 6, rounds=n, l1=0.0)
    losses = [loss(*fit(n)) for n in (0, 20, 300)]
    assert losses[0] > losses[1] > losses[2]
    w, t = fit(3000)
    for i in range(2):
        for step in (-0.05, 0.05):
            moved = t.copy()
            moved[i] += step
            assert loss(w, moved) > loss(w, t)


def test_edge_rows(spark):
    known = spark.createDataFrame([(i, 0) for i in (1, 2, 3, 4, 6, 9, 10, 11)] + [(15, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(spark), known).collect()
    assert len(got) == documents(spark).count()
    assert len({r.p_toxic for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert len(toxicity.toxicity(clashing(spark), known).collect()) == len(got)
    assert toxicity.toxicity(empty(spark), known).collect() == []
    none = toxicity.toxicity(documents(spark), known.limit(0)).collect()
    assert {r.p_toxic for r in none} == {0.5}
    assert toxicity.drop_toxic(empty(spark), toxicity.Severity({}, np.array([0.0]))).collect() == []


def test_dropping_agrees_with_the_decisions(spark):
    docs, known = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    model = toxicity.fit(docs, known)
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in toxicity.toxicity(docs, known).collect() if not r.toxic}
