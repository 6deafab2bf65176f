"""Best-fit packing with large-item matching, decided on the histogram of piece lengths.

Only documents longer than a sequence are cut: into whole sequences, with a shorter first piece
that holds the remainder. Pieces over a third of the capacity are large: at most two share a sequence.
The longest large piece left takes the longest large partner that fits (greedy matching); then the small pieces, longest
first, go to the tightest gap that holds them, and what fits nowhere opens new sequences.

Pieces of equal length are interchangeable, so all of this runs on counts per length: at most
``capacity`` numbers, whatever the corpus. The outcome is a list of fillings (multiset of lengths,
number of sequences); a piece finds its place by its rank among the pieces of its length. Ranks come
from ``ranks.rank_in_groups``, so a length shared by a third of all pieces is spread too.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, materialize
from .ranks import buckets_for, hash_bucket, rank_in_groups
from .tokens import encoder

CAPACITY = 1024
PIECES = "id long, piece int, start long, length int, ids_crc32 long"
PIECE_ARROW = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                         ("ids_crc32", pa.int64())])


def piece_starts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: one if it fits, else whole
    sequences after a first piece with the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def cut_documents(ranks_path: str, pattern: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    rows.extend((ident, n, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
                                for n, (start, length) in enumerate(piece_starts(len(ids) // 4, capacity)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_ARROW)], schema=PIECE_ARROW)
    return run


def match_large(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of the large pieces: (lengths, number of sequences), longest first, at most two each.
    Uses up the counts of ``left``."""
    out, lengths = [], sorted(left, reverse=True)
    for long in lengths:
        while left[long]:
            partner = next((s for s in lengths if s <= capacity - long and s <= long and left[s] > (s == long)), None)
            if partner is None:
                take, filling = left[long], (long,)
            elif partner == long:
                take, filling = left[long] // 2, (long, long)
            else:
                take, filling = min(left[long], left[partner]), (long, partner)
            for s in filling:
                left[s] -= take
            out.append((filling, take))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, number of sequences) that hold every piece of ``histogram`` (length -> count).

    A length splits at most two groups of equal sequences and opens at most two, so their number
    stays below four times the number of lengths."""
    large = {s: n for s, n in histogram.items() if 3 * s > capacity}
    gaps: dict[int, list] = defaultdict(list)  # free room -> groups of equal sequences
    for filling, n in match_large(large, capacity):
        gaps[capacity - sum(filling)].append((filling, n))
    for s in sorted((s for s in histogram if 3 * s <= capacity), reverse=True):
        n = histogram[s]
        for room in sorted(g for g in gaps if g >= s):
            fit, groups, stay = room // s, gaps.pop(room), []
            for filling, count in groups:
                whole = min(count, n // fit)
                n -= whole * fit
                rest = n if whole < count else 0
                n -= rest
                if whole:
                    gaps[room - fit * s].append((filling + (s,) * fit, whole))
                if rest:
                    gaps[room - rest * s].append((filling + (s,) * rest, 1))
                if untouched := count - whole - bool(rest):
                    stay.append((filling, untouched))
            if stay:
                gaps[room].extend(stay)
            if not n:
                break
        if n:
            fit = capacity // s
            if n // fit:
                gaps[capacity - fit * s].append(((s,) * fit, n // fit))
            if n % fit:
                gaps[capacity - (n % fit) * s].append(((s,) * (n % fit), 1))
    return [group for groups in gaps.values() for group in groups]


def places(fillings: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Arrays, sorted by (length, first rank), that say where the piece of some rank among its length goes:
    sequence ``base + (rank - first) // each``, offset ``at + (rank - first) % each * length``."""
    rows, taken, base = [], defaultdict(int), 0
    for filling, count in fillings:
        at = 0
        for s in sorted(set(filling), reverse=True):
            each = filling.count(s)
            rows.append((s, taken[s], base, each, at))
            taken[s] += count * each
            at += each * s
        base += count
    rows.sort()
    return dict(zip(("length", "first", "base", "each", "at"), np.array(rows, np.int64).reshape(-1, 5).T))


def place_batch(where: dict[str, np.ndarray]):
    starts = np.searchsorted(where["length"], np.arange(int(where["length"].max(initial=0)) + 2))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        length, rank = named["length"].to_numpy().astype(np.int64), named["rank"].to_numpy()
        row = np.empty(len(length), np.int64)
        for s in np.unique(length):
            mine = length == s
            low, high = starts[s], starts[s + 1]
            row[mine] = low + np.searchsorted(where["first"][low:high], rank[mine], side="right") - 1
        past = rank - where["first"][row]
        named["sequence_id"] = pa.array(where["base"][row] + past // where["each"][row])
        named["offset"] = pa.array(where["at"][row] + past % where["each"][row] * length)
        keep = [n for n in named if n != "rank"]
        return pa.RecordBatch.from_arrays([named[n] for n in keep], keep)
    return run


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of ``docs``: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` (gapless from 0) and ``offset`` (gapless inside a sequence).

    A document is its ids and ``end_id``; null and empty texts are one piece of length 1. Rows without
    an id and repeated rows are packed like any other; an empty table gives an empty result."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(cut_documents(ranks_path, pattern, end_id, capacity), PIECES)
                         .withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    where = places(plan(histogram, capacity))
    mixed = pieces.withColumn("bucket", hash_bucket(F.xxhash64("id", "piece", "row"), buckets_for(pieces, sum(histogram.values()))))
    ranked = rank_in_groups(mixed, ["length"], "bucket", ["id", "piece", "ids_crc32"]) \
        .select("id", "piece", "start", "length", "ids_crc32", "rank")
    placed = ranked.mapInArrow(by_batch(place_batch(where)), f"{PIECES}, sequence_id long, offset long")
    return placed.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"),
                         "ids_crc32", "sequence_id", "offset")
