"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional
bytes. A posting list per single byte would hold 1/256 of all fingerprints, so the index is kept
over triples of positional bytes instead: with the positions dealt into two halves, 5 shared
positions always put 3 into one half, so the 4+4 triples inside the halves miss no pair. The pairs of a
posting list are tallied (bytes shared by position), those with the guaranteed minimum are kept and
verified bit by bit, and each list leaves only a spanning star of each connected set,
never all its pairs. Lists beyond ``LIST_ROWS`` are cut into blocks compared two and two.

Equal fingerprints are one node; components are found on distinct fingerprints only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh, materialize
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
LIST_ROWS = 4096

#: BITS[v] holds bit i of byte v in lane i: eight counters of eight bits in one integer.
BITS = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each shingle of ``words`` words (fewer words: of the whole sequence; none: nothing)."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)] if found else []
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], SEED) for a, b in zip(starts[:len(found) - words + 1].tolist(), ends[words - 1:].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint (uint64) of each consecutive run of ``hashes``: bits set in over half of the run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    pieces = -(-size // 255)  # a lane counts to 255
    piece_of = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(piece_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, piece_start = first[piece_of] + 255 * nth, np.cumsum(pieces) - pieces
    for byte in range(8):
        lanes = BITS[(hashes >> np.uint64(8 * byte)) & np.uint64(255)]
        counts = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, piece_start, axis=0)
        bits = 2 * counts > size[:, None]
        out[full] |= (bits * (np.uint64(1) << np.arange(8, dtype=np.uint64))).sum(1).astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprint_batch(words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = []
        for at in range(0, batch.num_rows, 500):
            each = [shingle_hashes(t, words) for t in batch.column(1).slice(at, 500).to_pylist()]
            flat = np.array([h for hashes in each for h in hashes], np.uint64)
            prints.append(majority(flat, np.array([len(hashes) for hashes in each])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64)), *batch.columns[2:]],
                                          ["id", "fp", *batch.schema.names[2:]])
    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE, **longs: Column) -> DataFrame:
    """(id long, fp long: the 64 bits as a signed number, ``longs``); null texts count as empty: fingerprint 0."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       *[c.cast("long").alias(n) for n, c in longs.items()]) \
        .mapInArrow(by_batch(fingerprint_batch(words)), ", ".join(f"{n} long" for n in ("id", "fp", *longs)))


def _hook(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the sets of each pair; ``label`` points every element to the smallest of its set."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Count filter on shared positional bytes, then the exact distance."""
    differ = np.bitwise_xor(a, b)
    hit = np.zeros(differ.shape, bool)
    shared = (differ[..., None].view(np.uint8).reshape(*differ.shape, 8) == 0).sum(-1, dtype=np.uint8)
    kept = shared >= 8 - bits
    hit[kept] = np.bitwise_count(differ[kept]) <= bits
    return hit


def link_runs(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the near pairs inside each run of equal ``keys`` (sorted)."""
    label = np.arange(len(keys))
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= 64, sizes)
    for gap in range(1, int(sizes[sizes <= 64].max(initial=0))):
        at = np.flatnonzero(small[:-gap] & (keys[gap:] == keys[:-gap]))
        at = at[_near(prints[at], prints[at + gap], bits)]
        _hook(label, at, at + gap)
    for first, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        run = prints[first:first + size]
        for at in range(0, size, 256):
            rows, cols = np.nonzero(_near(run[at:at + 256, None], run[None, :], bits))
            _hook(label, first + at + rows, first + cols)
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return prints[moved], prints[label[moved]]


def link_lists(bits: int):
    """Streams posting lists (sorted by key), some whole lists at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(keys, prints) -> pa.RecordBatch:
            a, b = link_runs(keys, prints, bits)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.append(keys, batch.column(0).to_numpy())
            prints = np.append(prints, batch.column(1).to_numpy().view(np.uint64))
            if len(keys) and keys[0] != keys[-1]:
                last = int(np.searchsorted(keys, keys[-1]))
                yield send(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
        if len(keys):
            yield send(keys, prints)
    return run


def posting_keys(fp: Column, bits: int = MAX_BITS) -> list[Column]:
    """Keys of one fingerprint: triples of positional bytes that catch any two sharing 8 - bits bytes."""
    if not 0 <= bits <= 3:
        raise ValueError("triples of bytes find pairs of up to 3 differing bits")
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    triples = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
    return [F.lit(n << 24) + byte[a] * (1 << 16) + byte[b] * (1 << 8) + byte[c] for n, (a, b, c) in enumerate(triples)]


def fingerprint_links(prints: DataFrame, bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b), a > b, for distinct fingerprints ``fp``: links whose connected sets are those of all
    pairs within ``bits`` bits."""
    postings = prints.select("fp", F.explode(F.array(*posting_keys(F.col("fp"), bits))).alias("key"))
    long_lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_rows)
    dealt = postings.join(long_lists, "key", "left")
    half = list_rows // 2
    blocks = F.ceil(F.col("n") / half)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_except(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array("mine"))))
    pairs = dealt.select("fp", "key", F.coalesce(blocks, F.lit(0)).cast("long").alias("blocks")) \
        .withColumn("mine", F.when(F.col("blocks") > 0, mine).otherwise(0).cast("long")).withColumn("other", other)
    # key fits 27 bits; two block numbers of 18 bits each follow it
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    listed = pairs.select((F.shiftleft("key", 36) + F.shiftleft(lo, 18) + hi).alias("list"), "fp")
    return listed.repartition("list").sortWithinPartitions("list").mapInArrow(link_lists(bits), "a long, b long")


def with_roots(classes: DataFrame, bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(fp, first, root) for ``classes`` (fp, first), one row per fingerprint: ``root`` names its component."""
    roots = components(fingerprint_links(classes.select("fp"), bits, list_rows)) \
        .select(F.col("node").alias("fp"), "root")
    return classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                    bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest
    id reachable over links of at most ``bits`` bits, its own included).

    Texts without words (null and empty ones too) have fingerprint zero, linked like any other.
    Rows without an id take part, but give their component no name: it is null only where no row of
    it has an id. Repeated rows are in the same component; an empty table gives an empty result."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "fingerprint-classes")
    placed = with_roots(classes, bits, list_rows)
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("fp", "root").join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                         "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component left: that of the smallest id, of rows with one id that of the
    smallest text hash, of equal rows any; columns unchanged. A row without an id stays only if no row of its
    component has one. Rows are written once with a key, so that the one left is the one decided on."""
    key = fresh(docs, "_row")
    written = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "near-rows")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = fingerprints(written, id_col, text_col, raw=F.xxhash64(text), row=F.col(key))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "raw", "row")).alias("first")
    classes = materialize(rows.groupBy("fp").agg(first), "fingerprint-classes")
    keep = with_roots(classes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(key))
    return written.join(keep, key, "left_semi").drop(key)
