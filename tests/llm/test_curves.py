"""Hilbert order, measured recall against brute force, ties, and vectors that take no part."""

import itertools
import math

import numpy as np
import pytest
from conftest import SF_CHECK

from sparkqa.llm import curves, registry
from sparkqa.session import table

FLOATS = "vec_id long, embedding array<float>, label int"


def brute(vectors, every, k):
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and len(v) == 3 and None not in v
            and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_one_step_apart(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = curves.hilbert_keys(cells, bits)
    order = np.argsort(keys)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_query_reaches_its_recall(spark):
    e = table(spark, SF_CHECK, "embeddings").collect()
    x = np.array([r.embedding for r in e], float)
    ids = np.array([r.vec_id for r in e])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = lists(registry.QUERIES["op5_hilbert_neighbours"](spark, SF_CHECK))
    hits = total = 0
    for n in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[n]
        s[n] = -9
        true = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = got[int(ids[n])]
        assert len(mine) == 5 and int(ids[n]) not in {i for i, _ in mine}
        hits += len(true & {i for i, _ in mine})
        total += 5
    assert hits >= 0.9 * total


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(40)]                      # a hot vector, queries among its copies
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [math.nan, 1.0, 1.0]), (204, [math.inf, 1.0, 1.0]),
             (250, [1.0, 1.0]), (300, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], FLOATS).withColumnRenamed("label", "cls")
    got = lists(curves.nearest(df, every=10, window=10_000, curves=2))
    want = brute(rows, 10, 5)
    assert set(got) == set(want)
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in found], abs=1e-15)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1)], FLOATS)
    assert lists(curves.nearest(df)) == {0: [(1, 0.0)]}
    assert curves.nearest(spark.createDataFrame([], FLOATS)).collect() == []
    assert curves.nearest(spark.createDataFrame([(0, None, 1), (50, [0.0], 1)], FLOATS)).collect() == []
    assert curves.nearest(df.where("vec_id = 0")).collect() == []


def test_scaled_copies_tie_to_the_smaller_id(spark):
    rows = [(i, [(2.0 ** (i % 60)) * c for c in (1.0, 2.0, 3.0)]) for i in range(100, 40, -1)] + [(i, [1.0, float(i), 0.0]) for i in range(20)]
    rows += [(i, [3.0 * i, 2.0 * i, float(i)]) for i in range(200, 260)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got, want = lists(curves.nearest(df, every=10, window=10_000, curves=2)), brute(rows, 10, 5)
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in found] for q, found in want.items()}


def test_ties_are_scored_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((4, 3)), 30, 0) * 2.0 ** rng.integers(-3, 4, (120, 1))
    ids = rng.permutation(120)
    whole = [a.tolist() for a in curves.best_of(x, x, ids, None, 6)]
    monkeypatch.setattr(curves, "PAIRS", 50)
    assert [a.tolist() for a in curves.best_of(x, x, ids, None, 6)] == whole
    for n in range(120):
        mine = [ids[r] for q, r in zip(*whole[:2]) if q == n]
        assert mine == sorted(ids[n // 30 * 30:n // 30 * 30 + 30])[:6]
