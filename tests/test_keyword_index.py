"""The written keyword index: equal to brute force with and without skipping, opened once written, repeated keys."""

import math
import random
import re
from collections import Counter

import pytest

from sparkqa.operators import keyword


def brute(questions, docs, k):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    tfs = [(key, n, Counter(words(t))) for n, (key, t) in enumerate(docs)]
    df = Counter(w for key, _, c in tfs if key is not None for w in c)
    out = set()
    for q, t in questions:
        asked = set(words(t))
        scored = [(-round(sum(c[w] * math.log(len(docs) / df[w]) for w in sorted(asked) if w in c), 6), key, n)
                  for key, n, c in tfs if key is not None and asked & set(c)]
        out |= {(q, key, rank + 1, -s) for rank, (s, key, _) in enumerate(sorted(scored)[:k])}
    return out


def found(hits):
    return {(r.q, r.key, r["rank"], round(r.score, 6)) for r in hits.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    topic = lambda n: [f"t{n}w{i}" for i in range(30)]
    docs = [(f"d{n:04}", " ".join(rng.choice(topic(n // 100)) for _ in range(rng.randint(0, 40))) + " the") for n in range(3000)]
    docs += [("d0001", "t0w1 t0w1 again"), (None, "t0w1 nobody"), ("e", None), ("f", ""), ("g", "the the the")]
    questions = [(n, " ".join(rng.choice(topic(n % 30)) for _ in range(5))) for n in range(60)] + [(100, "the"), (101, "unknown words"), (102, None), (103, "The, the!")]
    return docs, questions


def test_equals_brute_force_and_skips_ranges(spark, corpus, monkeypatch, tmp_path):
    docs, questions = corpus
    d = spark.createDataFrame(docs, "key string, text string").coalesce(1)
    q = spark.createDataFrame(questions, "q int, text string")
    monkeypatch.setattr(keyword, "RANGE_BITS", 6)
    monkeypatch.setattr(keyword, "RANGE_DOCS", 64)
    index = keyword.build_index(d, "key", "text", path=str(tmp_path / "index"))
    want = brute(questions, docs, 3)
    seen = []
    scored = keyword._scored
    monkeypatch.setattr(keyword, "_scored", lambda visits, *rest: seen.append(visits.where("qk < 60").count()) or scored(visits, *rest))
    assert found(keyword.search(q, "q", "text", index)) == want
    ranges = index.blocks.select("range").distinct().count()
    assert ranges > keyword.FEW_RANGES and sum(seen) < 0.2 * 60 * ranges        # blocks that can't reach the third score stay unread
    monkeypatch.setattr(keyword, "FEW_RANGES", 1000)
    assert found(keyword.search(q, "q", "text", index)) == want


def test_written_once_and_opened(spark, tmp_path):
    d = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "key int, text string")
    path = str(tmp_path / "index")
    keyword.build_index(d, "key", "text", path=path)
    other = keyword.build_index(d.limit(0), "key", "text", path=path)           # the path is complete: it is opened
    hits = keyword.search(spark.createDataFrame([("x", "blue")], "q string, text string"), "q", "text", other, k=5)
    assert [(r.key, r["rank"]) for r in hits.collect()] == [(2, 1)]
    blocks = other.blocks.orderBy("term").collect()
    assert [(b.term, b.max_tf, len(b.docs)) for b in blocks if b.term == "blue"] == [("blue", 1, 1)]
    assert keyword.search(spark.createDataFrame([], "q string, text string"), "q", "text", other).collect() == []


def test_two_builds_of_one_path_keep_the_first(spark, tmp_path):
    from sparkqa.session import finish_folder, scratch_path
    for n in (1, 2):
        folder = scratch_path(spark, "twice")
        spark.range(n).write.parquet(folder)
        finish_folder(spark, folder, str(tmp_path / "final"))
    assert spark.read.parquet(str(tmp_path / "final")).count() == 1
