"""Codes, errors and codebooks against all-pairs distances, block shortlists, and awkward rows."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F

import compare
from sparkqa.llm import codes, registry
from sparkqa.session import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(id, code, error, label error, digest) by every distance of every part to every entry."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in kept], np.int64)
    w = x.shape[1] // 16
    books = [x[:64, p * w:(p + 1) * w].copy() for p in range(16)]

    def nearest(p):
        d = ((x[:, None, p * w:(p + 1) * w] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)
    for _ in range(2):
        for p in range(16):
            at = nearest(p)[0]
            for e in set(at.tolist()):
                books[p][e] = x[at == e, p * w:(p + 1) * w].sum(0) // (at == e).sum()
    found = [nearest(p) for p in range(16)]
    error, by_label = sum(d for _, d in found), defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((i, "".join(f"{found[p][0][n]:02x}" for p in range(16)), int(error[n]), by_label[label], digest)
                   for n, (i, _, label) in enumerate(kept)), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in codes.vector_codes(df, **options).collect()), key=repr)


def test_query_matches_sql_and_brute_force(spark):
    df = registry.QUERIES["op12_vector_codes"](spark, SF_CHECK)
    s_cols, s_rows, d_cols, d_rows = compare.compare(df, compare.duck(SF_CHECK), registry.ORACLES["op12_vector_codes"])
    assert s_cols == d_cols and s_rows == d_rows
    raw = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF_CHECK, "embeddings").collect()]
    assert sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == brute(raw)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 32) / 2], None if i % 7 == 0 else i % 3) for i in range(90)]
    rows += [(5, rows[5][1], 1), (5, rows[8][1], None), (None, rows[3][1], 2), (200, None, 1), (201, [], 1), (202, [1.0] * 31 + [None], 1),
             (203, [float("nan")] * 32, 1), (204, [float("inf")] * 32, 1), (205, [0.0] * 32, 1), (206, [-0.001] * 32, 1)] * 2
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == want
    clash = df.withColumns({n: F.lit("clash") for n in ("id", "vector", "of", "code", "error", "ids", "parts", "width", "label_error", "count")})
    assert got(clash.repartition(7)) == want  # neither other columns nor the dealing of rows matter
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 1), (2, [None], 2)], SCHEMA)) == []


def test_few_rows_other_lengths_and_large_components(spark):
    few = [(3, [0.5] * 16, 1), (1, [0.25] * 16, 1), (2, [1.0] * 16, None)]
    assert got(spark.createDataFrame(few, SCHEMA)) == brute(few)
    assert got(spark.createDataFrame([*few, (9, [1.0] * 48, 1)], SCHEMA)) == brute(few)  # the commonest length
    with pytest.raises(ValueError):
        got(spark.createDataFrame([(1, [1.0] * 17, 1)], SCHEMA))
    limit = codes.component_limit(16)
    huge = got(spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1), (3, [2e5] * 16, 2)], SCHEMA), rounds=0)
    assert [r[2] for r in huge] == [0, 0, 0] and limit > 1 << 27
    ends = codes.integers(np.array([[1e300, -1e300]]))
    assert (ends == [[codes.component_limit(2), -codes.component_limit(2)]]).all()


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(2)
    for width, spread in ((1, 6), (4, 10), (4, 400), (3, 3)):
        points = rng.integers(-spread, spread, (501, width))
        book = rng.integers(-spread, spread, (40, width))
        flat = {k: v.astype(np.int64) for k, v in codes.flat_blocks(points).items()}
        near, error = codes.assign(flat, book)
        d = ((points[:, None] - book) ** 2).sum(2)
        assert (near == d.argmin(1)).all() and (error == d.min(1)).all()
        count, total = codes.block_sums(flat, book)
        for e in range(40):
            assert count[e] == (near == e).sum() and (total[e] == points[near == e].sum(0)).all()
    assert codes.shortlists(flat["low"], flat["high"], book).sum(1).mean() < 40


def test_several_chunks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(16)], i % 2) for i in range(300)]
    monkeypatch.setattr(codes, "CHUNK", 70)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
