"""Vector search: how often the index is sent, and what leaves a task."""

import numpy as np

from sparkqa.operators import quantised, vectors


def frame(spark, matrix, key="id", vector="vector"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{key} long, {vector} array<double>")


def isotropic(n, dim=64, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def _probes(index, q, nprobe=1):
    return vectors._probe(q, "qid", "qvec", index.cell_arrays(), index.cells, nprobe, 1)


def test_index_is_not_sent_more_often_for_its_parts(spark):
    idx = vectors.build_index(frame(spark, isotropic(500, 4)), "id", nlist=1, rows_per_part=10)
    q = frame(spark, isotropic(500, 4, 6), "qid", "qvec")
    p, chunks = vectors._query_chunks(_probes(idx, q), "qid", "qvec")
    assert [r["_chunks"] for r in chunks.collect()] == [1]        # 500 queries of one cell, whatever its 50 parts
    assert p.count() == 500 * 50


def test_equal_vectors_do_not_all_leave_a_task(spark):
    idx = vectors.build_index(frame(spark, [[1.0, 0.0]] * 3000 + [[0.5, 0.0]] * 10), "id", nlist=1)
    q = frame(spark, [[1.0, 1.0], [0.0, 0.0]], "qid", "qvec")
    assert vectors._candidates(_probes(idx, q), idx, "qid", "qvec", False, 3).count() == 6
    assert sorted((r.qid, r["rank"], r.hit_key) for r in vectors.topk_join(q, idx, 3, exclude_self=True).collect()) == \
        [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 0), (1, 2, 2), (1, 3, 3)]


def test_tiles_equal_brute_force_with_ties_and_odd_numbers():
    rng = np.random.default_rng(1)
    d = rng.integers(-2, 3, size=(5000, 4)).astype(float)         # many equal scores over several tiles
    d[7, 0], d[4100, 1] = np.nan, np.inf
    q = rng.integers(-2, 3, size=(700, 4)).astype(float)
    own = (np.arange(700), np.arange(700) * 7)
    with np.errstate(invalid="ignore"):
        score = q @ d.T
        rows, cols, vals = vectors.best_rows(q, d, 5, own)
    score[own] = -np.inf
    for i in range(700):
        fine = [j for j in range(5000) if np.isfinite(score[i, j])]
        want = sorted(fine, key=lambda j: (-score[i, j], j))[:5]
        assert list(cols[rows == i]) == want and list(vals[rows == i]) == [score[i, j] for j in want]
    rows, cols, _ = vectors.best_rows(q[:2], d[:2], 5, None)      # fewer rows than asked for
    assert sorted(zip(rows, cols)) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_codes_without_clusters_leave_few_rows(spark):
    idx = vectors.build_index(frame(spark, isotropic(3000)), "id", nlist=1, rows_per_part=1000)
    q = frame(spark, isotropic(60, seed=6), "qid", "qvec")
    coded = quantised.add_codes(idx)
    assert quantised.survivors(q, coded, 3, 1, "qid", "qvec").count() < 0.02 * 60 * 3000
    hits = lambda df: sorted((r.qid, r["rank"], r.hit_key, round(r.score, 9)) for r in df.collect())
    assert hits(quantised.topk_coded(q, coded, 3, 1)) == hits(vectors.topk_ann(q, idx, 3, 1))
