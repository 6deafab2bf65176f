"""PPM scores against a brute-force model that walks the contexts byte by byte."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL

from edge import clashing, documents, empty, rows
from sparkqa.llm import lm
from sparkqa.session import table


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def brute(docs):
    texts = [(i, (t or "").encode().lower().split()) for i, t in docs]
    trie, tally = defaultdict(Counter), Counter()
    for i, words in texts:
        if not held(i):
            tally.update([*words, b"\n"])
            data = b"\n" * 4 + b" ".join(words) + b"\n"
            for at in range(4, len(data)):
                for k in range(5):
                    trie[data[at - k:at]][data[at]] += 1
    n, v = sum(tally.values()), len(tally)

    def byte(context, x):
        out, excluded = 0.0, set()
        for k in range(4, -1, -1):
            found = trie.get(context[4 - k:])
            if not found:
                continue
            left = {s: c for s, c in found.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if x in left:
                return out + math.log10(left[x] / total)
            out += math.log10(len(left) / total)
            excluded |= set(found)
        return out - math.log10(256 - len(excluded))

    memo, result = {}, []
    for i, words in texts:
        tokens = [*words, b"\n"]
        base = sum(math.log10((tally[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        data, score = b"\n" * 4 + b" ".join(words) + b"\n", 0.0
        for at in range(4, len(data)):
            key = data[at - 4:at + 1]
            if key not in memo:
                memo[key] = byte(key[:4], key[4])
            score += memo[key]
        result.append((i, held(i), len(tokens), sum(tally[w] > 0 for w in tokens), n, base, score))
    return result


def check(got, want):
    assert len(got) == len(want)
    order = lambda r: (repr(r[:5]), round(r[5], 3))
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk_bytes", [lm.CHUNK_BYTES, 20_000])
def test_scores_match_brute_force(spark, chunk_bytes):
    docs = table(spark, SF_SMALL, "documents").repartition(3)
    got = lm.language_model_scores(docs, chunk_bytes=chunk_bytes).collect()
    check(got, brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_edge_rows(spark):
    got = lm.language_model_scores(documents(spark)).collect()
    check(got, brute([(r.doc_id, r.text) for r in documents(spark).collect()]))
    assert rows(lm.language_model_scores(clashing(spark)))[0][:3] == sorted((tuple(r) for r in got), key=repr)[0][:3]


def test_empty_table_and_no_training_text(spark):
    assert lm.language_model_scores(empty(spark)).collect() == []
    only = [i for i in range(100) if held(i)][:2]
    docs = spark.createDataFrame([(i, "ab") for i in only], "doc_id long, text string")
    for r in lm.language_model_scores(docs).collect():
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0
        assert r.score == pytest.approx(-3 * math.log10(256))
