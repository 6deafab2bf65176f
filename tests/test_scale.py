"""What grows with the tables: work per row, and rows that leave a task."""

import numpy as np
import pandas as pd
import pyarrow as pa

from sparkqa.operators import embed, evaluation as ev, keyword


def test_answer_match_cuts_each_text_into_words_once(spark):
    rows = spark.createDataFrame([(1, "a b b c", "b c d"), (2, "", "x"), (3, None, "x"), (4, "q", "q"), (5, "a", "b")],
                                 "i int, response string, expected_response string")
    m = ev.best_match(ev.answer_match(rows), "i")
    assert m._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    got = {r.i: tuple(r)[1:] for r in m.collect()}
    assert got[1] == (0.666667, 0.666667, 0.666667, False, True)
    assert got[2] == (None, 0.0, None, False, True)
    assert got[3] == (None, None, None, None, None)
    assert got[4] == (1.0, 1.0, 1.0, True, True) and got[5] == (0.0, 0.0, 0.0, False, True)


def test_blocks_of_a_range_are_made_over_borders_of_batches():
    rows = pa.table({"doc": pa.array([8, 9, 10, 11, 12, 13], pa.int64()), "key": pa.array([1, None, 3, 4, 5, 6], pa.int64()),
                     "words": pa.array([["a", "b", "a"], ["a"], None, ["b"], [], ["a"]], pa.list_(pa.string()))})
    out = [r for b in keyword._range_blocks(2)(rows.to_batches(max_chunksize=3)) for r in b.to_pylist()]
    blocks = sorted((r["range"], r["term"], r["max_tf"], r["docs"], r["tfs"]) for r in out if r["term"])
    assert blocks == [(2, "a", 2, [0], [2]), (2, "b", 1, [0, 3], [1, 1]), (3, "a", 1, [1], [1])]
    assert [(r["range"], r["keys"]) for r in out if r["term"] is None] == [(2, [1, None, 3, 4]), (3, [5, 6])]


def test_vectors_of_a_batch_are_counted_in_blocks():
    buckets = [np.array([i % 7, i % 3], dtype="int32") if i % 5 else None for i in range(3 * embed.COUNT_ROWS)] + [np.array([], dtype="int32")]
    got = embed._unit_bincount.func(pd.Series(buckets), pd.Series([8] * len(buckets)))
    for b, v in zip(buckets, got):
        want = None if b is None else np.bincount(b, minlength=8).astype(float)
        assert (v is None) == (want is None)
        assert want is None or np.allclose(v, want / max(np.linalg.norm(want), 1))
