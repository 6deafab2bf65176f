"""Owners against a dictionary of normalised texts; tries against plain sets under tiny budgets."""

import hashlib
import random
import re

import pytest
from conftest import SF_SMALL

from compare import compare, duck
from edge import clashing, documents, empty, rows
from sparkqa.llm import exact_dedup as ed
from sparkqa.llm import registry
from sparkqa.session import table


def brute(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in docs:
        mine = groups[norm(t)]
        keep = min(mine)[3]
        out.append((i, keep, len(mine), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [ed.TRIE_BYTES, 2_000])
def test_edge_rows(spark, budget):
    want = brute([(r.doc_id, r.text) for r in documents(spark).collect()])
    assert rows(ed.exact_duplicates(documents(spark).repartition(4), trie_bytes=budget)) == want
    assert rows(ed.exact_duplicates(clashing(spark), trie_bytes=budget)) == want


def test_matches_oracle(spark):
    got, want = compare(registry.QUERIES["op3_exact_duplicates"](spark, SF_SMALL), duck(SF_SMALL),
                        registry.ORACLES["op3_exact_duplicates"])[1::2]
    assert got == want


def test_empty_table(spark):
    assert ed.exact_duplicates(empty(spark)).collect() == []
    assert ed.drop_exact_duplicates(empty(spark)).columns == empty(spark).columns


def test_dropping_keeps_columns_and_owners(spark):
    docs = clashing(spark)
    left = ed.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    owners = {(i, k) for i, k, _, kept, _ in brute([(r.doc_id, r.text) for r in docs.collect()]) if kept}
    assert {r.doc_id for r in left.collect()} == {i for i, _ in owners}


def test_hot_group_over_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same  text' ELSE concat('t', id) END AS text")
    got = ed.exact_duplicates(docs.repartition(16))
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 AND keep_id = 0").count() == 1000


@pytest.mark.parametrize("budget", [1, 500, 5_000, 1 << 20])
def test_tries_spill_without_loss(budget):
    rng = random.Random(budget)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) * rng.randint(1, 3) for _ in range(2000)] + [b"a" * 3000] * 3
    rows_ = [(k, (len(k), n, ("h", "d"), 1)) for n, k in enumerate(keys)]
    got = dict(ed.resolve(iter(rows_), budget))
    want = {}
    for k, o in rows_:
        want[k] = ed.better(want[k], o) if k in want else o
    assert got == want
    trie = ed.Patricia()
    for k, o in rows_:
        trie.insert(k, o)
    assert dict(trie.terminals(trie.root)) == want
    assert all(len(n.children) != 1 or n.owner is not None or n is trie.root for n in walk(trie.root))


def walk(node):
    yield node
    for child in node.children.values():
        yield from walk(child)
