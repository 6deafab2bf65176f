"""Invariants for the rows-only operators (13, 18) and exactness of op 17."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from sparkqa.operators import vectors
from sparkqa.operators.embed import embed
from sparkqa.session import table


def _emb(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    q = e.select(F.col("vec_id").alias("qid"), F.col("vector").alias("qvec"))
    return e, q


def _brute(e_rows, k):
    keys = np.array([r.vec_id for r in e_rows])
    m = np.array([r.vector for r in e_rows])
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    out = {}
    for i, qk in enumerate(keys):
        order = sorted(range(len(keys)), key=lambda j: (-round(s[i, j], 10), keys[j]))[:k]
        out[qk] = [keys[j] for j in order]
    return out


def test_index_one_cell_per_key(spark):
    e, _ = _emb(spark, SF_SMALL)
    idx = vectors.build_index(e, "vec_id", "vector", nlist=8)
    v = idx.vectors
    assert v.count() == e.count()
    assert v.select("vec_id").distinct().count() == e.count()
    assert v.filter(F.col("cell").isNull() | (F.col("cell") < 0) | (F.col("cell") >= 8)).count() == 0


def test_index_rejects_repeated_key(spark):
    e, _ = _emb(spark, SF_SMALL)
    try:
        vectors.build_index(e.unionByName(e.limit(1)), "vec_id", "vector", nlist=1)
        raise AssertionError("repeated key accepted")
    except ValueError:
        pass


def test_exact_equals_brute_force_and_full_probe_ann(spark):
    e, q = _emb(spark, SF_CHECK)
    idx = vectors.build_index(e, "vec_id", "vector", nlist=16)
    exact = vectors.topk_join(q, idx, k=3, nprobe=1, exclude_self=True).collect()
    got = {}
    for r in sorted(exact, key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.hit_key)
    assert got == _brute(e.collect(), 3)
    full = vectors.topk_ann(q, idx, k=3, nprobe=16, exclude_self=True).collect()
    got_full = {}
    for r in sorted(full, key=lambda r: (r.qid, r["rank"])):
        got_full.setdefault(r.qid, []).append(r.hit_key)
    assert got_full == got


def test_ann_recall_rises_with_probes(spark):
    e, q = _emb(spark, SF_CHECK)
    idx = vectors.build_index(e, "vec_id", "vector", nlist=16)
    truth = {(r.qid, r.hit_key) for r in vectors.topk_join(q, idx, k=3, nprobe=1, exclude_self=True).collect()}
    recalls = []
    for nprobe in (1, 4, 16):
        got = {(r.qid, r.hit_key) for r in vectors.topk_ann(q, idx, k=3, nprobe=nprobe, exclude_self=True).collect()}
        recalls.append(len(got & truth) / len(truth))
    assert recalls[0] <= recalls[1] <= recalls[2] == 1.0


def test_registered_approximate_search_has_its_recall(spark):
    from sparkqa import catalog
    truth = {(r.qid, r.hit_key) for r in catalog.QUERIES["similarity_topk_join"](spark, SF_CHECK).collect()}
    got = {(r.qid, r.hit_key) for r in catalog.QUERIES["similarity_topk_ann"](spark, SF_CHECK).collect()}
    assert len(got & truth) >= 0.9 * len(truth)


def test_hot_cell_is_split_into_parts(spark):
    e, q = _emb(spark, SF_SMALL)
    idx = vectors.build_index(e, "vec_id", "vector", nlist=1, rows_per_part=100)
    assert idx.vectors.select("part").distinct().count() == 5
    a = vectors.topk_join(q, idx, k=3, exclude_self=True).collect()
    b = vectors.topk_join(q, vectors.build_index(e, "vec_id", "vector", nlist=1), k=3, exclude_self=True).collect()
    assert sorted((r.qid, r["rank"], r.hit_key) for r in a) == sorted((r.qid, r["rank"], r.hit_key) for r in b)


def test_custom_embedder_runs_in_batches(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, t string")
    out = embed(df, "t", embedder=lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("id").collect()
    assert [r.vector for r in out] == [[3.0, 1.0], [1.0, 1.0]]


def test_index_written_partitioned_by_cell(spark, tmp_path):
    e, q = _emb(spark, SF_SMALL)
    path = str(tmp_path / "idx")
    idx = vectors.build_index(e, "vec_id", "vector", nlist=4, path=path)
    import os
    assert sorted(d for d in os.listdir(path + "/vectors") if d.startswith("cell=")) == [f"cell={i}" for i in range(4)]
    a = vectors.topk_join(q, idx, k=3, exclude_self=True).collect()
    b = vectors.topk_join(q, vectors.build_index(e, "vec_id", "vector", nlist=1), k=3, exclude_self=True).collect()
    assert sorted((r.qid, r["rank"], r.hit_key) for r in a) == sorted((r.qid, r["rank"], r.hit_key) for r in b)
    # building again at the same path opens the written index: no key check, no training
    dup = e.unionByName(e)                       # would fail the key check if it were read
    again = vectors.build_index(dup, "vec_id", "vector", nlist=4, path=path)
    c = vectors.topk_join(q, again, k=3, exclude_self=True).collect()
    assert sorted((r.qid, r["rank"], r.hit_key) for r in c) == sorted((r.qid, r["rank"], r.hit_key) for r in a)
    assert sorted(tuple(r) for r in again.cells.collect()) == sorted(tuple(r) for r in idx.cells.collect())


def test_given_centers_keep_search_exact(spark):
    e, q = _emb(spark, SF_CHECK)
    given = vectors.build_index(e, "vec_id", "vector", nlist=8)
    idx = vectors.build_index(e, "vec_id", "vector", centers=given.cells)
    assert sorted(tuple(r) for r in idx.vectors.select("vec_id", "cell").collect()) == \
        sorted(tuple(r) for r in given.vectors.select("vec_id", "cell").collect())
    assert idx.vectors.count() == e.count()
    got = {}
    for r in sorted(vectors.topk_join(q, idx, k=3, nprobe=1, exclude_self=True).collect(),
                    key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.hit_key)
    assert got == _brute(e.collect(), 3)


def test_approximate_retrieval_in_the_answer_chain(spark):
    """The chain's retrieval with every cell probed equals exact retrieval; with fewer
    probes each question still gets at most k real corpus rows, best first."""
    from sparkqa import fixtures as fx
    from sparkqa.functions import messages
    from sparkqa.plans import rag
    from sparkqa.session import table
    corpus = fx.corpus(spark, SF_SMALL)
    idx = rag.corpus_index(corpus, nlist=4)
    reqs = messages.first_user_message(table(spark, SF_SMALL, "conversations")).withColumnRenamed("conv_id", "qid")
    cols = ["qid", "rank", "nct_number"]
    exact = sorted(tuple(r) for r in rag.retrieve(reqs, idx, corpus).select(*cols).collect())
    full = sorted(tuple(r) for r in rag.retrieve(reqs, idx, corpus, nprobe=4).select(*cols).collect())
    assert full == exact
    ann = rag.retrieve(reqs, idx, corpus, nprobe=1).select(*cols).collect()
    keys = {r.nct_number for r in corpus.select("nct_number").collect()}
    per_q = {}
    for r in ann:
        assert r.nct_number in keys
        per_q.setdefault(r.qid, []).append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 3 for v in per_q.values())
