"""The pipeline against a plain Python version of its stages, and the registration of all queries."""

import os
import sys

from conftest import ROOT, SF_SMALL

from edge import clashing, empty
from sparkqa.llm import quality, toxicity
from sparkqa.session import table
from test_exact_dedup import brute as exact
from test_simhash import brute as near

sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["good_quality", "clean_language", "exact_copies", "near_copies", "packing"]
    assert os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))


def test_run_matches_plain_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    known = table(spark, SF_SMALL, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.quality(docs, known).collect() if r.predicted}
    calm = {r.doc_id for r in toxicity.toxicity(docs, known).collect() if not r.toxic}
    left = sorted(good & calm)
    left = [i for i, keep, _, _, _ in exact([(i, texts[i]) for i in left]) if i == keep]
    left = {i for i, _, c in near([(i, texts[i]) for i in left]) if i == c}
    packed = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == left
    assert 0 < len(left) < len(texts)


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    for docs in (empty(spark), clashing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            if name != "packing":
                assert out.columns == docs.columns, name
            out.collect()
