"""Fingerprints and components against a plain double loop."""

import random

import numpy as np
import pytest
import xxhash
from conftest import SF_SMALL

from edge import clashing, documents, empty, rows
from sparkqa.llm import components, registry, simhash
from sparkqa.session import table


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    names = {}
    for (i, _), g in zip(docs, group):
        if i is not None:
            names[g] = min(names.get(g, i), i)
    return sorted(((i, f"{p:016x}", names.get(g)) for (i, _), p, g in zip(docs, prints, group)), key=repr)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    assert rows(registry.QUERIES["op6_simhash_components"](spark, SF_SMALL)) == brute(docs)


def test_edge_rows(spark):
    want = brute([(r.doc_id, r.text) for r in documents(spark).collect()])
    assert rows(simhash.near_duplicates(documents(spark))) == want
    assert rows(simhash.near_duplicates(clashing(spark))) == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_dropping_keeps_one_of_each_component(spark):
    docs = clashing(spark)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {c for _, _, c in brute([(r.doc_id, r.text) for r in docs.collect()])}


def test_dropping_keeps_one_row_of_each_component(spark):
    """One id on several texts, rows repeated with id and text, and rows without id."""
    lorem = [f"word{i}" for i in range(400)]
    near = [" ".join(lorem[:390] + [f"tail{n}"]) for n in range(3)]
    assert len({fingerprint(t) for t in near}) > 1
    docs = [(1, near[0]), (1, near[1]), (1, near[0]), (2, near[2]), (7, "alone here"), (7, "alone here"), (7, "quite another text"),
            (None, near[0]), (None, "no name at all"), (None, "no name at all"), (None, "nor has this one a name")]
    left = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left if r.text not in near) == [
        (0, "no name at all"), (0, "nor has this one a name"), (7, "alone here"), (7, "quite another text")]
    assert len({c for _, _, c in brute([(1, t) for t in near])}) == 1
    assert [r.doc_id for r in left if r.text in near] == [1]


@pytest.mark.parametrize("list_rows", [simhash.LIST_ROWS, 8])
def test_links_lose_no_component(spark, list_rows):
    """Dense and sparse fingerprints, with posting lists whole and cut into blocks."""
    rng = random.Random(list_rows)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for center in list(prints)[:6]:
        for _ in range(60):
            near = center
            for b in rng.sample(range(64), rng.randint(1, 5)):
                near ^= 1 << b
            prints.add(near)
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), list_rows=list_rows)
    root = {r.node: r.root for r in components.components(links).collect()}
    group = {p: p for p in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert {p: root.get(p, p) for p in signed} == group


def test_components_of_chain_star_and_cycle(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(1, 30)] + [(201, 200), (202, 201), (202, 200), (202, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 99 for i in range(1, 30)}, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
