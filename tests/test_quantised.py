"""Search by quantised codes: the same rows as the scan of the vectors, recall on clusters, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sparkqa.operators import quantised, vectors
from sparkqa.session import table

DIM, CLUSTERS, ROWS, ASKED = 32, 20, 4000, 200


def frame(spark, keys, matrix, key="id", vector="vector"):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(keys, matrix)], f"{key} long, {vector} array<double>")


def clustered(seed=3):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(CLUSTERS, DIM))
    heart /= np.linalg.norm(heart, axis=1)[:, None]
    spot = lambda n: heart[rng.integers(0, CLUSTERS, n)] + rng.normal(size=(n, DIM)) * 0.05
    return spot(ROWS), spot(ASKED)


def hits(df):
    return sorted((r.qid, r["rank"], r.hit_key, round(r.score, 9)) for r in df.collect())


def test_equals_the_scan_of_the_vectors(spark):
    e = table(spark, SF_SMALL, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    q = e.select(F.col("vec_id").alias("qid"), F.col("vector").alias("qvec"))
    idx = vectors.build_index(e, "vec_id", "vector", nlist=8, rows_per_part=40)
    for part_dims in (1, 2, 5):              # 5 leaves a narrower last run
        coded = quantised.add_codes(idx, part_dims)
        for nprobe in (2, 8):
            got = hits(quantised.topk_coded(q, coded, 3, nprobe, exclude_self=True))
            assert got == hits(vectors.topk_ann(q, idx, 3, nprobe, exclude_self=True))


def test_clusters_need_few_cells_and_few_vectors(spark):
    rows, asked = clustered()
    idx = vectors.build_index(frame(spark, range(ROWS), rows), "id", nlist=CLUSTERS)
    coded = quantised.add_codes(idx)
    q = frame(spark, range(ASKED), asked, "qid", "qvec")
    score = np.round(asked @ rows.T, 10)
    truth = {(i, j) for i in range(ASKED) for j in sorted(range(ROWS), key=lambda j: (-score[i, j], j))[:3]}
    got = {(r.qid, r.hit_key) for r in quantised.topk_coded(q, coded, 3, 3).collect()}
    assert len(got & truth) >= 0.9 * len(truth)
    size = {r.cell: r.n for r in idx.cells.collect()}
    visited = vectors._probe(q, "qid", "qvec", idx.cell_arrays(), idx.cells, 3, 1).select("qid", "cell").distinct().collect()
    scanned = sum(size[r.cell] for r in visited)
    assert scanned < 0.2 * ASKED * ROWS
    assert quantised.survivors(q, coded, 3, 3, "qid", "qvec").count() < 0.1 * scanned


def test_codes_decode_to_within_their_error(spark):
    rows, _ = clustered()
    idx = vectors.build_index(frame(spark, range(500), rows[:500]), "id", nlist=4)
    coded = quantised.add_codes(idx, 3)
    pdf = coded.codes.toPandas()
    assert len(pdf) == 500 and set(pdf["code"].map(len)) == {-(-DIM // 3)}
    near = quantised.decode(pdf["cell"].to_numpy(), pdf["code"], idx.cell_arrays()[0], coded.books)
    assert np.allclose(np.linalg.norm(near - rows[pdf["id"].to_numpy()], axis=1), pdf["err"], atol=1e-12)


def test_few_rows_ties_nulls_and_nothing(spark, tmp_path):
    same = [[1.0, 0.0, 2.0]] * 5 + [[0.0, 0.0, 0.0], [3.0, 0.0, 0.0]]
    idx = vectors.build_index(frame(spark, range(7), same), "id", nlist=1)
    coded = quantised.add_codes(idx, path=str(tmp_path / "codes"))
    q = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0])], "qid int, qvec array<double>")
    got = [(r.qid, r["rank"], r.hit_key) for r in quantised.topk_coded(q, coded, 3, 1).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (3, 1, 0), (3, 2, 1), (3, 3, 2)]     # ties go to the smaller key
    assert quantised.topk_coded(q, coded, 20, 1).filter("qid = 1").count() == 7           # fewer rows than asked for
    assert quantised.topk_coded(q.filter("qid = 2"), coded, 3, 1).count() == 0
    nothing = quantised.add_codes(vectors.build_index(frame(spark, [], []), "id", nlist=1))
    assert nothing.codes.count() == 0 and quantised.topk_coded(q, nothing, 3, 1).count() == 0


def test_answer_chain_with_codes(spark):
    from sparkqa import fixtures as fx
    from sparkqa.functions import messages
    from sparkqa.plans import rag
    corpus = fx.corpus(spark, SF_SMALL)
    idx = rag.corpus_index(corpus, nlist=4)
    asked = messages.first_user_message(table(spark, SF_SMALL, "conversations")).withColumnRenamed("conv_id", "qid")
    cols = ["qid", "rank", "nct_number"]
    by_vectors = rag.retrieve(asked, idx, corpus, nprobe=2).select(*cols).collect()
    by_codes = rag.retrieve(asked, quantised.add_codes(idx), corpus, nprobe=2).select(*cols).collect()
    assert by_vectors and sorted(by_codes) == sorted(by_vectors)
