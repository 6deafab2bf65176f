"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected to a few dimensions, once per curve with another random basis and another
shift of the grid, and gets its place on the Hilbert curve through that grid. Spark range-partitions the
rows of each curve by place; a row's position is its rank along the curve. Near vectors lie
near on at least one of the curves, so a query looks at the rows up to ``window`` positions away on
each, all of them scored by their exact cosine; the best of all curves are merged.

The window is not guessed: for a bounded sample of queries the true neighbours are found by brute force,
and the window is the gap (on the nearest of the curves) that covers ``RECALL`` of them. On tight
clusters that is a few rows; on vectors without structure it grows with the table, as it must.

Equal vectors are one point of the curves, which carries its smallest ids only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, materialize, parallelism

CURVES = 8
DIMENSIONS = 4
BITS = 9
BLOCK = 2048
GROUP_QUERIES = 8192  # queries that a block is scored against in one group, about
SAMPLE_QUERIES = 64  # bound on the queries that the window is measured on
SAMPLE_VECTORS = 20_000  # bound on the vectors that the grid is scaled on
SLACK, PAIRS = 1e-12, 1 << 15  # of rough cosines; pairs scored at once
RECALL = 0.95  # aimed at on the sample; the contract asks for 0.9
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (rows of coordinates below 2**bits), after Skilling's transform:
    undo the excess rotations from the top bit down, Gray-code, then interleave the bits."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            turned = (x[i] & bit) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    keys = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> level) & 1)
    return keys


class Grid:
    """One projection, scale and shift per curve; fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int, seed: int) -> None:
        self.bits, random, width = bits, np.random.default_rng(seed), sample.shape[1]
        self.dimensions = min(dimensions, width)
        self.bases = [np.linalg.qr(random.standard_normal((width, width)))[0][:, :self.dimensions] for _ in range(curves)]
        self.shifts = [random.random(self.dimensions) for _ in range(curves)]
        self.cuts = [np.quantile(sample @ b, np.linspace(0, 1, 257)[1:-1], axis=0) for b in self.bases]

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        out = []
        for basis, shift, cuts in zip(self.bases, self.shifts, self.cuts):
            spread = unit @ basis
            # quantiles fill the lower half of the grid evenly, the shift moves it by up to another half
            level = np.stack([np.searchsorted(cuts[:, i], spread[:, i]) for i in range(self.dimensions)], 1) / 256
            out.append(hilbert_keys(((level + shift) / 2 * (1 << self.bits)).astype(np.int64), self.bits))
        return out


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length from their bytes, in double precision; ``kind``: f4 or f8, as they are stored."""
    return np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_batch(width: int, kind: str):
    """Keeps rows whose vector has ``width`` finite components, not all zero (nor of a norm that is not a positive number)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, kept = [], []
        for ident, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ident is None or v is None or len(v) != width or None in v:
                continue
            x = np.array(v, np.float64) + 0.0  # no negative zeros
            if np.isfinite(norm := float(np.sqrt((x * x).sum()))) and norm > 0:
                ids.append(ident)
                kept.append(x.astype(kind).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["id", "vec"])
    return run


def place_batch(grid: Grid, kind: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ident, vec, asks = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        keys = grid.keys(units(matrix(vec.to_pylist(), kind)))
        spare = 62 - grid.dimensions * grid.bits
        # rows of one cell are told apart by a hash, so that a crowded cell can be split
        mixed = (ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - spare)
        n, curves = len(ident), len(keys)
        again = pa.array(np.tile(np.arange(n), curves))
        places = np.concatenate([(k << spare) | mixed.astype(np.int64) for k in keys])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(curves, dtype=np.int32), n)), pa.array(places),
                                           batch.column(0).take(again), vec.take(again), asks.take(again)],
                                          ["curve", "place", "cls", "vec", "asks"])
    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; the same pair gives the same bits anywhere."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, near: np.ndarray | None, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, cosine) of the ``keep`` best rows of each query, ties to the smaller of ``ids``;
    ``near`` masks pairs out of reach. All rows whose rough product reaches the last one kept, less ``SLACK``,
    are scored, however many tie."""
    rough = units(queries) @ units(rows).T
    if near is not None:
        rough[~near] = -np.inf
    last = max(len(rows) - keep, 0)
    hit = (rough >= np.partition(rough, last, axis=1)[:, last:last + 1] - SLACK) & np.isfinite(rough)
    pairs, out = np.cumsum(hit.sum(1)), []
    for some in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(pairs // PAIRS)) + 1):
        q, r = np.nonzero(hit[some])
        q = some[q]
        score = cosines(queries[q], rows[r])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < keep
        out.append((q[best], r[best], score[best]))
    return tuple(map(np.concatenate, zip(*out)))


def search_block(keep: int, window: int, kind: str):
    """Scores the queries that reach a block of a curve against the block's rows."""
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x, at, ids = matrix(rows["vec"], kind), rows["pos"].to_numpy(), rows["cls"].to_numpy()
            for first in range(0, len(queries), 1024):
                some = queries.iloc[first:first + 1024]
                y, pos, asked = matrix(some["vec"], kind), some["pos"].to_numpy(), some["cls"].to_numpy()
                q, r, score = best_of(y, x, ids, np.abs(pos[:, None] - at[None, :]) <= window, keep)
                out.append(pd.DataFrame({"asked": asked[q], "cls": ids[r], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"asked": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"),
                                                        "score": pd.Series(dtype="float64")})
    return run


def brute_batch(queries: np.ndarray, asked: np.ndarray, keep: int, kind: str):
    """The best rows of a batch for each of a bounded set of queries."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, r, score = best_of(queries, matrix(batch.column(1).to_pylist(), kind), batch.column(0).to_numpy(), None, keep)
        return pa.RecordBatch.from_arrays([pa.array(asked[q]), batch.column(0).take(pa.array(r)), pa.array(score)], ["asked", "cls", "score"])
    return run


def best_rows(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "cls")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def measured_window(classes: DataFrame, placed: DataFrame, k: int, total: int, recall: float, kind: str) -> int:
    """Gap along the curves that covers ``recall`` of the true neighbours of a bounded sample of queries."""
    asked = classes.where("asks").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_QUERIES).select("cls", "vec").toArrow()
    if not asked.num_rows:
        return 0
    ids, vectors = asked["cls"].to_numpy(), matrix(asked["vec"].to_pylist(), kind)
    true = best_rows(classes.select("cls", "vec").mapInArrow(by_batch(brute_batch(vectors, ids, k + 1, kind)), "asked long, cls long, score double"),
                     k + 1).where("asked != cls").select("asked", "cls").toArrow().to_pylist()  # (k + 1) rows for each sample query
    wanted = sorted({t["cls"] for t in true} | set(ids.tolist()))
    at = {(r.curve, r.cls): r.pos for r in placed.where(F.col("cls").isin(wanted)).select("curve", "cls", "pos").collect()}
    curves = {c for c, _ in at}
    gaps = [min(abs(at[c, t["asked"]] - at[c, t["cls"]]) for c in curves) for t in true]
    return int(np.quantile(gaps, recall, method="higher")) if gaps else total


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
            curves: int = CURVES, recall: float = RECALL, block: int = BLOCK, window: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id is divisible by ``every``,
    by cosine in double precision, ties to the smaller id, the query itself left out.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite components
    take no part, nor do rows without id. A repeated id is several candidates with one id, of which a
    query lists each vector once. Queries with fewer candidates list all that there are; an empty
    table gives an empty result. ``window`` replaces the measured one."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # single precision holds float components exactly: half the bytes to carry along the curves
    kind = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    common = raw.where("v IS NOT NULL").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    valid = materialize(raw.mapInArrow(by_batch(valid_batch(common.w if common else 0, kind)), "id long, vec binary"), "vectors")
    asks = F.pmod("id", F.lit(every)) == 0
    # equal vectors: one class, named by its smallest id, with the k + 1 smallest ids (cut before the shuffle)
    smallest = valid.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    groups = smallest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    queries = valid.where(asks).groupBy("vec").agg(F.lit(True).alias("asks"))
    classes = materialize(groups.join(queries, "vec", "left").select(
        F.col("ids")[0].alias("cls"), "vec", F.coalesce("asks", F.lit(False)).alias("asks"), "ids"), "vector-classes")
    total = classes.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    share = min(1.0, SAMPLE_VECTORS / total)
    sample = classes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)) \
        .orderBy("cls").limit(2 * SAMPLE_VECTORS).select("vec").toArrow()
    grid = Grid(units(matrix(sample["vec"].to_pylist(), kind)), curves, DIMENSIONS, BITS, SEED)
    ranged = classes.select("cls", "vec", "asks").mapInArrow(by_batch(place_batch(grid, kind)), "curve int, place long, cls long, vec binary, asks boolean") \
        .repartitionByRange(2 * parallelism(spark), "curve", "place").sortWithinPartitions("curve", "place", "cls")
    # the id that Spark gives to a row: its partition in the upper bits, its place in it in the lower 33
    numbered = materialize(ranged.withColumn("row", F.monotonically_increasing_id()), "curve-places")
    part, nth = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = materialize(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "range-starts")
    placed = numbered.withColumn("part", part).join(F.broadcast(before), "part").select(
        "curve", "cls", "vec", "asks", (F.col("before") + nth - F.col("curve").cast("long") * total).alias("pos"))
    reach = measured_window(classes, placed, k, total, recall, kind) if window is None else window
    # a block meets the queries of a whole window: dealt into so many parts that each stays small
    share_asked = classes.where("asks").count() / total
    parts = max(1, round((2 * reach + block) * share_asked / GROUP_QUERIES))
    rows = placed.select("curve", F.floor(F.col("pos") / block).cast("long").alias("block"), "cls", "vec", "pos",
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    low, high = F.greatest(F.col("pos") - reach, F.lit(0)), F.least(F.col("pos") + reach, F.lit(total - 1))
    blocks = F.sequence(F.floor(low / block).cast("long"), F.floor(high / block).cast("long"))
    # aliases tell the two sides apart: both come from the same table
    asked = placed.where("asks").select(*[F.col(c).alias(c) for c in ("curve", "cls", "vec", "pos")], F.explode(blocks).alias("block"),
                                        F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int").alias("part"))
    found = rows.groupBy("curve", "block", "part").cogroup(asked.groupBy("curve", "block", "part")) \
        .applyInPandas(search_block(k + 1, reach, kind), "asked long, cls long, score double")
    top = best_rows(found, k + 1)
    # back to ids: every query of a class, every small id of the classes found
    hits = top.select("asked", "cls", "score").join(classes.select("cls", "ids"), "cls") \
        .select("asked", "score", F.explode("ids").alias("vec_id"))
    short = hits.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = short.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), F.col("vec_id").alias("v")))).alias("hits"))
    members = valid.where(asks).select(F.col("id").alias("query_id"), "vec").distinct().join(
        classes.select(F.col("cls").alias("asked"), "vec"), "vec").select("query_id", "asked")
    own = F.filter("hits", lambda h: h["v"] != F.col("query_id"))
    return members.join(lists, "asked").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.v").alias("vec_id"), (-F.col("hit.s")).alias("score"))
