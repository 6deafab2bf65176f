"""Trees against a plain walk, held-out accuracy, and the contract's columns."""

import math
import zlib

import numpy as np
from conftest import SF_CHECK, SF_SMALL

from edge import clashing, documents, empty
from sparkqa.llm import quality, registry
from sparkqa.session import table


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    scored = {r.doc_id: r for r in registry.QUERIES["op10_quality_trees"](spark, SF_CHECK).collect()}
    assert len(scored) == table(spark, SF_CHECK, "documents").count()
    held = [(r.quality, scored[r.doc_id]) for r in table(spark, SF_CHECK, "labels").collect() if scored[r.doc_id].held_out]
    assert len(held) > 40
    assert sum(y == r.predicted for y, r in held) >= 0.97 * len(held)
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    model = quality.fit_trees(x, y, trees=30, depth=3)
    scores = model.score(x)
    assert ((scores >= 0.5) == (y > 0)).mean() > 0.97
    for i in range(0, 400, 37):
        total = model.start
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        assert math.isclose(scores[i], 1 / (1 + math.exp(-total)), rel_tol=1e-12)


def test_scores_depend_on_the_text_only_and_never_on_held_out_labels(spark):
    docs, known = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    score = lambda d, k: {r.doc_id: r.score for r in quality.quality(d, k).collect()}
    base = score(docs, known)
    turned = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, 0) for r in known.collect()]
    assert score(docs, labels(spark, turned)) == base
    shuffled = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'zz' AS source", "0L AS n_chars").repartition(5)
    assert score(shuffled, known) == base


def test_edge_rows(spark):
    known = labels(spark, [(1, 1, 0), (3, 0, 0), (6, 1, 0), (14, 0, 0), (14, 0, 1), (None, 1, 0), (2, None, 0)])
    got = quality.quality(documents(spark), known).collect()
    assert len(got) == documents(spark).count()
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[12]) == 1 and by_id[3] == by_id[4]
    assert sorted(r.score for r in quality.quality(clashing(spark), known).collect()) == sorted(r.score for r in got)
    assert quality.quality(empty(spark), known).collect() == []
    assert {r.score for r in quality.quality(documents(spark), labels(spark, [])).collect()} == {0.5}


def test_dropping_agrees_with_the_scores(spark):
    docs, known = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    model = quality.fit(quality.document_statistics(docs, "doc_id", "text"), known)
    left = quality.drop_poor(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in quality.quality(docs, known).collect() if r.predicted}
