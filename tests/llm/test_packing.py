"""Pieces against the tokenizers library, places against the laws, plans against lower bounds."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL

from edge import clashing, documents, empty
from sparkqa.llm import packing, registry, tokens
from sparkqa.session import table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check(found, docs, library):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    texts = Counter((i, t or "") for i, t in docs)
    for i, mine in by_doc.items():
        same = [t for j, t in docs if j == i]
        want = Counter()
        for t in same:
            ids = ids_of(library, t)
            for n, (start, length) in enumerate(packing.piece_starts(len(ids), 1024)):
                crc = zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
                want[n, start, length, crc] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in mine) == want
    assert set(by_doc) == {i for i, _ in texts}
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_query(spark, library):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    found = registry.QUERIES["op4_best_fit_packing"](spark, SF_SMALL).collect()
    check(found, docs, library)
    total = sum(r["length"] for r in found)
    assert len({r["sequence_id"] for r in found}) <= 1.02 * total / 1024 + 1


def test_edge_rows(spark, library):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    check(registry.pack_documents(documents(spark)).collect(), docs, library)
    check(registry.pack_documents(clashing(spark)).collect(), docs, library)
    assert registry.pack_documents(empty(spark)).collect() == []


def test_pieces_of_long_documents():
    assert packing.piece_starts(1024, 1024) == [(0, 1024)]
    assert packing.piece_starts(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.piece_starts(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1024])
    histogram = Counter(rng.randint(1, capacity) if seed % 2 else min(capacity, 1 + int(rng.expovariate(4 / capacity)))
                        for _ in range(3000))
    fillings = packing.plan(dict(histogram), capacity)
    held = Counter()
    for filling, n in fillings:
        assert n > 0 and sum(filling) <= capacity
        assert sum(3 * s > capacity for s in filling) <= 2
        for s in filling:
            held[s] += n
    assert held == histogram
    assert len(fillings) <= 4 * len(histogram)
    sequences = sum(n for _, n in fillings)
    bound = max(-(-sum(s * n for s, n in histogram.items()) // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))
    assert sequences <= 1.25 * bound + 2
    where = packing.places(fillings)
    assert len(where["length"]) >= len(histogram)


def test_memo_gives_the_library_ids(library):
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo_pieces=50)
    rng = random.Random(5)
    alphabet = list(" \n\t 　a1'sé-\x1c\x85東🙂") + ["the", " of", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
