"""What a search writes and sends: survivors of the codes, postings of the keyword index."""

import numpy as np
import pyarrow as pa
import pytest

from sparkqa.operators import embed, keyword, quantised, vectors


def isotropic(n, dim=16, seed=5):
    return np.random.default_rng(seed).normal(size=(n, dim))


def frame(spark, matrix, key="id", vector="vector"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{key} long, {vector} array<double>")


def test_survivors_of_the_codes_stay_in_their_task(spark, monkeypatch):
    idx = vectors.build_index(frame(spark, isotropic(3000)), "id", nlist=4, rows_per_part=400)
    coded = quantised.add_codes(idx)
    q = frame(spark, isotropic(60, seed=6), "qid", "qvec")
    written, keep = [], quantised.materialize
    monkeypatch.setattr(quantised, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    got = quantised.topk_coded(q, coded, 3, 4).collect()
    assert max(df.count() for df in written) <= 3 * 60          # no table grows with what the codes leave
    assert quantised.survivors(q, coded, 3, 4, "qid", "qvec").count() > 3 * 60
    hits = lambda rows: sorted((r.qid, r["rank"], r.hit_key, round(r.score, 9)) for r in rows)
    assert hits(got) == hits(vectors.topk_ann(q, idx, 3, 4).collect())


def test_scan_of_codes_equals_scan_of_vectors():
    rng = np.random.default_rng(9)
    d = rng.integers(-2, 3, (5000, 6)).astype(float)            # many ties
    d[17] = np.nan
    near = d + rng.normal(size=d.shape) * 0.3
    err = np.sqrt(((d - near) ** 2).sum(axis=1)) + 1e-12
    q = np.vstack([rng.normal(size=(700, 6)), np.zeros((3, 6))])
    own = np.arange(0, 700, 7), np.arange(0, 700, 7) * 3
    for bound, mine in ((np.full(703, vectors.NO_THRESHOLD), own), (np.full(703, 2.0), None)):
        rows, cols, vals = quantised.best_coded(q, near, err, d, 4, bound, mine)
        want = vectors.best_rows(q, d, 4, mine)
        keep = want[2] >= bound[want[0]]
        have = vals >= bound[rows]
        assert list(zip(rows[have], cols[have])) == list(zip(want[0][keep], want[1][keep]))
        assert np.allclose(vals[have], want[2][keep])
    rows, cols, _ = quantised.best_coded(q[:2], near[:2], err[:2], d[:2], 4, np.full(2, vectors.NO_THRESHOLD))
    assert sorted(zip(rows, cols)) == [(0, 0), (0, 1), (1, 0), (1, 1)]       # fewer rows than asked for


def test_a_range_is_sent_once_for_many_questions(spark, monkeypatch):
    monkeypatch.setattr(keyword, "RANGE_BITS", 4)
    monkeypatch.setattr(keyword, "RANGE_DOCS", 16)
    docs = spark.createDataFrame([(n, f"a{n % 50} b{n % 7} the") for n in range(700)], "key int, text string").coalesce(1)
    questions = spark.createDataFrame([(n, f"a{n % 50} b{n % 7}") for n in range(5000)], "q int, text string")
    index = keyword.build_index(docs, "key", "text")
    written, keep = {}, keyword.materialize
    monkeypatch.setattr(keyword, "materialize", lambda df, label: written.setdefault(label, []).append(keep(df, label)) or written[label][-1])
    hits = keyword.search(questions, "q", "text", index, 1).collect()
    ranges = index.blocks.select("range").distinct().count()
    assert [b.count() for b in written["asked-blocks"]] == [ranges]         # one row a range, not one a word of it
    assert max(v.count() for v in written["visited-ranges"]) <= ranges      # not once for every few questions
    assert {r.q: r.key for r in hits} == {n: min(m for m in range(700) if m % 50 == n % 50 and m % 7 == n % 7) for n in range(5000)}


def test_hits_of_a_range_equal_brute_force():
    rng = np.random.default_rng(2)
    tf = rng.integers(0, 3, (40, keyword.RANGE_DOCS)) * (rng.random((40, keyword.RANGE_DOCS)) < 0.02)
    tf[5] = 1                                                               # a word of all documents
    tf[7] = 0
    idf = np.round(rng.random(40), 2)
    idf[5] = 0.0
    ids = np.flatnonzero(tf.any(axis=1)) * 3
    word, doc = np.nonzero(tf)
    sizes = np.bincount(word, minlength=40)[ids // 3]
    asked = [[5], [5, 7], [7], [0, 1, 2, 39], [99], sorted(rng.choice(40, 12, replace=False))] * 30
    terms = np.array([w * 3 for a in asked for w in a])
    for k in (1, 4, 30):
        found = keyword._range_hits(terms, np.array([len(a) for a in asked]), ids, idf[ids // 3], sizes, doc, tf[word, doc], k)
        rows, cols, scores = (np.concatenate(x) for x in zip(*found))
        for n, a in enumerate(asked):
            own = [w for w in a if w < 40]
            total, shared = (idf[own, None] * tf[own]).sum(axis=0), (tf[own] > 0).any(axis=0)
            want = sorted(np.flatnonzero(shared), key=lambda j: (-round(total[j], 9), j))[:k]
            assert sorted(cols[rows == n]) == sorted(want)
            assert np.allclose(sorted(scores[rows == n]), sorted(total[want]))


def test_single_precision_leaves_few_pairs_to_score(monkeypatch):
    q, d = isotropic(600, 32, 7), isotropic(20_000, 32, 8)
    pairs, dots = [], vectors.dots
    monkeypatch.setattr(vectors, "dots", lambda qm, dm, rows, cols: pairs.append(len(rows)) or dots(qm, dm, rows, cols))
    rows, cols, vals = vectors.best_rows(q, d, 3)
    assert sum(pairs) < 0.01 * len(q) * len(d)
    score = q @ d.T
    want = np.argsort(-score, axis=1, kind="stable")[:, :3]
    assert np.array_equal(cols.reshape(-1, 3), want) and np.allclose(vals.reshape(-1, 3), np.take_along_axis(score, want, 1), atol=1e-12)
    far = vectors.best_rows(q * 1e30, d * 1e20, 3)                        # beyond single precision
    assert np.array_equal(far[1].reshape(-1, 3), want)


def test_each_distinct_word_is_hashed_once():
    lists = [["the", "fox"], None, [], ["the", "the", "ü"], ["fox"] * 5] * 200
    words = pa.array([["cut", "off"]] + lists, pa.list_(pa.string())).slice(1)
    calls, md5 = [], embed.md5
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(embed, "md5", lambda w, **how: calls.append(w) or md5(w, **how))
        got = embed.unit_counts(words, 64).to_pylist()
    assert sorted(calls) == sorted(w.encode() for w in ("the", "fox", "ü"))
    for n, texts in enumerate(lists):
        want = None if texts is None else np.bincount([int(md5(w.encode()).hexdigest()[:8], 16) % 64 for w in texts], minlength=64).astype(float)
        assert (got[n] is None) == (want is None)
        assert want is None or np.allclose(got[n], want / max(np.linalg.norm(want), 1))


def test_vectors_of_words_equal_their_buckets(spark):
    texts = spark.createDataFrame([(1, "The fox, the Fox ÄÖ 7"), (2, None), (3, " -- "), (4, "a")], "id int, text string")
    rows = texts.select("id", embed.hashed_embedding("text", 100).alias("v"), embed.token_buckets("text", 100).alias("b")).collect()
    for r in rows:
        want = None if r.b is None else np.bincount(np.array(r.b, int), minlength=100).astype(float)
        assert (r.v is None) == (want is None)
        assert want is None or np.allclose(r.v, want / max(np.linalg.norm(want), 1))


def test_many_rows_are_not_sent_once_per_few_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SMALL_CHUNK_ROWS", 10)
    monkeypatch.setattr(vectors, "GROUPS", 16)
    idx = vectors.build_index(frame(spark, isotropic(3000, 4)), "id", nlist=1)
    q = frame(spark, isotropic(100, 4, 6), "qid", "qvec")
    p, chunks = vectors._query_chunks(vectors._probe(q, "qid", "qvec", idx.cell_arrays(), idx.cells, 1, 1), "qid", "qvec")
    sent = vectors._dealt(idx.vectors.select("id", "cell", "part"), chunks, "id").count()
    assert sent <= 2 * 3000 and p.count() <= 100 * 16       # 10 chunks of queries sent 30,000 rows
    best = np.argsort(-(isotropic(100, 4, 6) @ isotropic(3000, 4).T), axis=1)[:, :3]
    assert {(r.qid, r["rank"], r.hit_key) for r in vectors.topk_join(q, idx, 3).collect()} == {(i, j + 1, best[i, j]) for i in range(100) for j in range(3)}
