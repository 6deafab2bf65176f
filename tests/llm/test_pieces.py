"""Ids against the public library (BPE model), against brute-force Viterbi (unigram), and round trips."""

import random

import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_SMALL

from edge import clashing, documents, empty, rows
from sparkqa.llm import pieces, registry
from sparkqa.session import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents_match_the_library(spark, library):
    for r in pieces.encode(table(spark, SF_SMALL, "documents"), PATH, "bpe").collect():
        assert r.ids == library.encode(r.text)
    found = registry.QUERIES["op7_sentencepiece_ids"](spark, SF_SMALL).collect()
    assert len(found) == table(spark, SF_SMALL, "documents").count() and all(r.round_trip for r in found)


def test_query_returns_the_ids(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    for r in registry.QUERIES["op7_sentencepiece_ids"](spark, SF_SMALL).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and len(r.ids) == r.n_ids


def test_random_texts_match_the_library(library):
    mine, rng = pieces.Pieces.load(PATH, "bpe"), random.Random(3)
    alphabet = list("   abcdeéü東🙂\n\t.<0x'\x00") + ["the", "ing", "  ", "tion"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert mine.encode(text) == library.encode(text)
        assert mine.decode(mine.encode(text)) == text
    for text in ("a" * 3000, " " * 500, "ab " * 300, "=" * 700):
        assert mine.encode(text) == library.encode(text)


def best_sums(table_, unit):
    """All segmentations' best sums, by plain dynamic programming over every substring."""
    best = [0.0] + [float("-inf")] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(e):
            i = table_.ids.get(unit[s:e])
            if i is not None:
                best[e] = max(best[e], best[s] + table_.scores[i])
            elif e - s == 1:
                best[e] = max(best[e], best[s] + table_.lowest)
    return best[-1]


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_takes_the_best_sum(with_bytes):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(40)} - {"c"})
    byte_ids = list(range(1 + len(words), 1 + len(words) + 256)) if with_bytes else []
    t = pieces.Pieces([None, *words, *([None] * len(byte_ids))], [0.0, *(-rng.random() * 5 for _ in words), *([0.0] * len(byte_ids))],
                      byte_ids, "unigram")
    for _ in range(500):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
        full = ("▁" + text).replace(" ", "▁")
        found = t.segment(full)
        assert "".join(found) == full
        total = sum(t.scores[t.ids[p]] if p in t.ids else t.lowest for p in found)
        assert total == pytest.approx(best_sums(t, full))
        if with_bytes:
            assert t.decode(t.encode(text)) == text


def test_edge_rows(spark, library):
    got = pieces.decode(pieces.encode(documents(spark), PATH, "bpe"), PATH, "bpe").collect()
    assert len(got) == documents(spark).count()
    for r in got:
        assert r.decoded == r.text
        assert r.ids == (None if r.text is None else library.encode(r.text))
    assert rows(pieces.encode(clashing(spark), PATH, "bpe")) == rows(pieces.encode(documents(spark), PATH, "bpe"))
    assert pieces.encode(empty(spark), PATH, "bpe").collect() == []
    with pytest.raises(ValueError):
        pieces.Pieces([], [], [], "word")
