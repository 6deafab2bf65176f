"""Passages contained in documents, against brute force, with passages of every shape."""

import random

import pytest

from sparkqa.operators import evaluation as ev


def brute(passages, docs):
    return sorted((p, k) for p, t in passages for k, d in docs if t is not None and d is not None and t in d)


def found(spark, passages, docs):
    p = spark.createDataFrame(passages, "p int, t string")
    d = spark.createDataFrame(docs, "k int, d string")
    return sorted(tuple(r) for r in ev.containing_docs(p, "p", "t", d, "k", "d").collect())


DOCS = [(0, "the cat sat on the mat"), (1, "concatenate  strings\tand\nlines"), (2, ""), (3, None), (4, "a"), (5, "Cat! cat? (catalog)"),
        (6, "caf\u00e9 \U0001F600\U0001F601 x"), (7, "aaaaaaaa"), (8, "..-- .. --"), (8, "the cat"), (9, " \n ")]


@pytest.mark.parametrize("texts", [
    ["cat", "Cat", "at", "t", "cat sat", "he cat", "on the"], ["aaa", "aaaaaaaaa", "aa", "a"], ["--", "..", "-- ..", "(cat", "cat?"],
    [" ", "  ", "\n", "\t", " \n"], ["\u00e9 ", "\U0001F600", "\U0001F600\U0001F601", "\U0001F601 x", "\u00e9"], ["", None, "zzz"],
    ["cat", "cat", "the cat sat on", "cat sat on the mat"]])
def test_passages_of_any_shape(spark, texts):
    passages = list(enumerate(texts))
    assert found(spark, passages, DOCS) == brute(passages, DOCS)


def test_random_passages(spark):
    rng = random.Random(11)
    docs = [(k, "".join(rng.choice("ab .\n") for _ in range(rng.randrange(60)))) for k in range(40)]
    passages = []
    for p in range(60):
        d = rng.choice(docs)[1]
        at = rng.randrange(len(d) + 1)
        passages.append((p, d[at:at + rng.randrange(9)] if p % 3 else "".join(rng.choice("ab .") for _ in range(rng.randrange(1, 7)))))
    assert found(spark, passages, docs) == brute(passages, docs)


def test_no_passages_and_no_documents(spark):
    assert found(spark, [], DOCS) == [] and found(spark, [(1, "cat")], []) == [] and found(spark, [(1, None)], DOCS) == []


def test_no_written_plan_pairs_passages_with_blocks_of_documents(spark, monkeypatch):
    """Every written stage too: each join is on a run, a gram, a text or a key."""
    plans = []

    def written(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **kwargs)

    real = ev.materialize
    monkeypatch.setattr(ev, "materialize", written)
    docs = spark.createDataFrame(DOCS, "k int, d string")
    out = ev.containing_docs(spark.createDataFrame([(1, "cat"), (2, "t s")], "p int, t string"), "p", "t", docs, "k", "d")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5
    for plan in plans:
        assert not any(op in plan for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "_part#", "BatchEvalPython"))
