"""The trie against dictionaries of whole prefixes, small sketches and stretches, and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest
from conftest import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F

import compare
from sparkqa.llm import prefixes, registry
from sparkqa.session import table

SCHEMA = "conv_id long, turn long, role string, text string"


def order_key(role, text):
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return [int.from_bytes(bytes.fromhex(digest[at:at + 16]), signed=True) for at in (0, 16)]


def conversations_of(rows):
    found = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            found[c].append((t is not None, t or 0, order_key(r or "", x or ""), r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in found.items()}


def rebuilt(orig):
    out = {}
    for c, turns in orig.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = orig.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def trie(convs):
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * words
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest())
                   for k, m in members.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_query_matches_sql_and_brute_force(spark):
    df = registry.QUERIES["op13_conversation_prefixes"](spark, SF_CHECK)
    s_cols, s_rows, d_cols, d_rows = compare.compare(df, compare.duck(SF_CHECK), registry.ORACLES["op13_conversation_prefixes"])
    assert s_cols == d_cols and s_rows == d_rows
    assert got(df) == trie(rebuilt(conversations_of(rows_of(table(spark, SF_CHECK, "conversations")))))


AWKWARD = [
    (0, 0, "user", "hello there"), (0, 1, "assistant", "hi"), (0, 2, "user", "more words here"), (0, 3, "assistant", "end"),
    *[(c, t, "user", f"q{t}") for c in range(1, 30) for t in range(c % 5)],
    *[(c, t, "user", "same opening" if t < 3 else f"own {c}") for c in range(40, 60) for t in range(5)],
    *[(c, t, "user", "copy") for c in (61, 62, 63, 64, 65) for t in range(4)],
    (70, None, None, None), (70, 0, "", ""), (70, 0, "user", "tie a"), (70, 0, "user", "tie b"), (70, 5, "user", "x" * 5000),
    (71, 1, "user", " \t\n"), (71, 1, "user", " \t\n"), (None, 0, "user", "nobody"), (None, None, None, None), (-7, 0, "user", "below"),
    (-25, 0, "user", "hello there"), (-25, 2, "user", "gap"), (1 << 40, 3, "user", "far"), (81, 0, "a", "bc"), (82, 0, "ab", "c"),
]


@pytest.mark.parametrize("small", [False, True])
def test_awkward_conversations(spark, monkeypatch, small):
    if small:  # every counter is shared, and windows reach over stretches of two turns
        monkeypatch.setattr(prefixes, "LEAST_CELLS", 64)
        monkeypatch.setattr(prefixes, "MOST_CELLS", 64)
        monkeypatch.setattr(prefixes, "STRETCH", 2)
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    want = trie(rebuilt(conversations_of(AWKWARD)))
    assert got(prefixes.conversation_prefixes(df)) == want
    clash = df.withColumns({n: F.lit("clash") for n in ("conv", "depth", "a", "b", "words", "base", "h", "digest", "p1", "last", "_pid", "stretch")})
    assert got(prefixes.conversation_prefixes(clash.repartition(5))) == want


def test_turnless_conversations_and_empty_tables(spark):
    rows = [(c, 0, "user", "only") for c in range(21, 40)]  # their lender, 20, is absent
    assert got(prefixes.conversation_prefixes(spark.createDataFrame(rows, SCHEMA))) == trie(rebuilt(conversations_of(rows)))
    assert prefixes.conversation_prefixes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixes.conversation_prefixes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_screening_proves_singletons_only(spark):
    turns, _ = prefixes.lend_openings(prefixes.turn_digests(spark.createDataFrame(AWKWARD, SCHEMA)))
    screened = prefixes.screen(prefixes.prefix_digests(turns)).collect()
    shared = defaultdict(int)
    for r in screened:
        shared[(r.p1, r.p2)] += 1
    assert all(r.maybe for r in screened if shared[(r.p1, r.p2)] > 1)
    assert sum(not r.maybe for r in screened) > 10
    marks = {(r.conv, r.depth): r for r in screened}
    for r in screened:
        up = marks.get((r.conv, r.depth - 1))
        assert (r.q1, r.q2) == ((up.p1, up.p2) if up else (0, 0)) and r.parent_maybe == (up is None or up.maybe)


def test_trie_as_it_stands_with_texts(spark):
    df = table(spark, SF_SMALL, "conversations")
    turns = prefixes.turn_digests(df)
    convs = turns.groupBy("conv").agg(F.max("depth").alias("length"))
    plain = prefixes.prefix_trie(turns, convs)
    orig = conversations_of(rows_of(df))
    assert got(plain) == trie(orig)
    for r in prefixes.with_last_turn(plain, df).collect():
        assert (r.role, r.text) == (orig[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_ids_of_one_node_cross_runs(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS_PER_RUN", 3)
    members = spark.range(-5, 40).selectExpr("2L AS depth", "7L AS p1", "8L AS p2", "id AS conv")
    assert [r.digest for r in prefixes.end_digests(members).collect()] == [hashlib.sha256(",".join(map(str, range(-5, 40))).encode()).hexdigest()]
