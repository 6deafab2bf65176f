"""Vector index and similarity search (ops 13, 15-19).

Index layout: ``vectors`` = (key, vector, cell, part, cdist, ...carried columns) and a
small ``cells`` table = (cell, centroid, radius, n, n_parts), one row per cell.
Cells come from MLlib KMeans; ``part`` splits big cells into sub-cells by a key hash so
that one hot cell never lands in a single task (salting fixed at build time).

Search never pairs every query with every vector:

* each query is expanded to the cells it must visit (numpy on Arrow batches, against the
  ``nlist`` centroids, which travel with the function: their number is the caller's parameter);
* queries and index rows are cogrouped on ``(cell, part, query chunk)`` and each group is
  scored with numpy matrix multiplies (BLAS) in bounded tiles; only the k best
  per query and group leave the task, however many rows tie with them;
* parts and chunks are large, and no more of them are cut than keep the tasks busy, as every part meets
  all chunks of its cell: both sides are sent once per row of the other side's grid;
* the final k per query come from ``row_number`` over a window (a WindowGroupLimit that
  trims before the shuffle).

Approximate search (op 18) visits the ``nprobe`` nearest cells. Exact search (op 17)
visits those first, takes the k-th best score per query as a threshold, and then visits
every other cell whose upper bound ``q.c + |q| * radius(c)`` (Cauchy-Schwarz) reaches the
threshold. No cell that could hold a top-k answer is skipped, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, path_exists
from .lookup import left_lookup

BOUND_SLACK = 1e-9           # float slack on the pruning bound
NO_THRESHOLD = -1.0e300
PART_ROWS = 65_536           # index rows of one part: what a task holds of the index


@dataclass
class VectorIndex:
    vectors: DataFrame
    cells: DataFrame
    key: str
    vector: str = "vector"

    def cell_arrays(self):
        """Centroids and radii as local arrays: ``nlist`` rows, the caller's parameter, not the data's."""
        rows = sorted(self.cells.select("cell", "centroid", "radius").collect())
        dim = len(rows[0]["centroid"]) if rows else 0
        ncell = (rows[-1]["cell"] + 1) if rows else 0
        cent = np.zeros((ncell, dim))
        rad = np.full(ncell, -1.0)         # -1 marks an empty cell: never visited
        for r in rows:
            cent[r["cell"]] = np.asarray(r["centroid"], dtype=float)
            rad[r["cell"]] = r["radius"]
        return cent, rad


def _assign_fn(key: str, vector: str, centers: np.ndarray):
    c2 = (centers * centers).sum(axis=1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.vstack(pdf[vector].map(lambda v: np.asarray(v, dtype=float)).to_numpy())
            d2 = c2[None, :] - 2.0 * (x @ centers.T)          # + |x|^2, same for every cell
            cell = d2.argmin(axis=1)
            diff = x - centers[cell]
            out = pdf.copy()
            out["cell"] = cell.astype("int32")
            out["cdist"] = np.sqrt((diff * diff).sum(axis=1))
            yield out
    return assign


def build_index(df: DataFrame, key: str, vector: str = "vector", nlist: int = 16, seed: int = 7,
                max_iter: int = 20, rows_per_part: int = PART_ROWS, path: str | None = None,
                centers: DataFrame | None = None) -> VectorIndex:
    """Cell-partitioned index over a keyed vector table (op 13).

    Raises if a key is null or repeated. Cells are KMeans centroids (``nlist == 1``
    skips training: one cell around the origin). The assigned table is written to
    ``path`` (``vectors`` partitioned by cell, then the ``cells`` table, whose commit marks
    the index complete) or as a table in the shared checkpoint folder, so searches do not
    re-run training or assignment. Building at a ``path`` that already holds a complete
    index is a no-op that opens it (``open_index``), so an index is built once and
    searched by any later job. Centroids are trained on all rows, or given: ``centers`` is a
    table (cell int from 0, centroid array<double>) such as an earlier index's ``cells``, and ``nlist`` is then ignored."""
    spark = df.sparkSession
    if path and path_exists(spark, f"{path}/cells/_SUCCESS"):
        return open_index(spark, path, key, vector)
    # one job: per-key counts (map-side combined), then the key check
    chk = (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max("n").alias("max_n"),
                F.count_if(F.col(key).isNull()).alias("null_keys")).first())
    if (chk["max_n"] or 0) > 1 or (chk["null_keys"] or 0) > 0:
        raise ValueError(f"index key {key!r} has null or repeated values")
    # a row without a vector has nothing to be found by: it is not indexed
    base = df.withColumn(vector, F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull())
    given, centers = centers, None      # nlist <= 1 and none given: one cell at the origin, sized below
    if given is not None:
        rows = sorted((r["cell"], r["centroid"]) for r in given.select("cell", "centroid").collect())   # a row per cell
        if [c for c, _ in rows] != list(range(len(rows))) or not rows:
            raise ValueError("centers need cells numbered from 0 without gaps")
        centers = np.array([v for _, v in rows], dtype=float)
        base = materialize(base, "vectors")
    elif nlist > 1:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        # training and assignment both read the vectors: write them once, so an upstream
        # embedding (model inference) runs once per row, not once per reader
        base = materialize(base, "vectors")
        feats = base.select(array_to_vector(F.col(vector)).alias("features"))
        model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
        centers = np.vstack([np.asarray(c, dtype=float) for c in model.clusterCenters()])
    if centers is None:
        # one cell around the origin: the distance to its centre is the norm, no Python pass
        assigned = base.withColumns({
            "cell": F.lit(0),
            "cdist": F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda acc, x: acc + x * x))})
    else:
        out_schema = T.StructType(base.schema.fields + [T.StructField("cell", T.IntegerType()),
                                                        T.StructField("cdist", T.DoubleType())])
        assigned = base.mapInPandas(_assign_fn(key, vector, centers), out_schema)
    if path:
        assigned.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        assigned = spark.read.parquet(f"{path}/vectors")
    else:
        assigned = materialize(assigned, "index")
    # one pass over the written index: rows and radius per cell, and the vector width
    stats = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("cdist").alias("radius"),
                                         F.max(F.size(vector)).alias("dim"))
    stat_list = stats.collect()                                          # <= nlist rows
    stat_rows = {r["cell"]: (r["n"], r["radius"]) for r in stat_list}
    if centers is None:
        centers = np.zeros((1, max([r["dim"] for r in stat_list] + [0])))
    cell_rows = []
    for i, c in enumerate(centers):
        n, radius = stat_rows.get(i, (0, -1.0))
        cell_rows.append((i, [float(v) for v in c], float(radius), int(n),
                          max(1, math.ceil(n / rows_per_part))))
    cells = spark.createDataFrame(cell_rows, CELLS_SCHEMA)
    if path:
        cells.write.mode("overwrite").parquet(f"{path}/cells")      # last: marks the index complete
        cells = spark.read.schema(CELLS_SCHEMA).parquet(f"{path}/cells")
    else:
        cells = materialize(cells, "cells")     # its size is known then, so joins with it shuffle nothing
    return VectorIndex(vectors=_with_parts(assigned, key, cells), cells=cells, key=key, vector=vector)


CELLS_SCHEMA = "cell int, centroid array<double>, radius double, n bigint, n_parts int"


def _with_parts(assigned: DataFrame, key: str, cells: DataFrame) -> DataFrame:
    """Sub-cell of every row: a key hash modulo its cell's part count (salting fixed at
    build time, so a hot cell is spread over many tasks). The counts are joined on the cell."""
    sized = assigned.join(cells.select("cell", F.col("n_parts").alias("_parts")), "cell")
    return sized.withColumn("part", F.pmod(F.xxhash64(F.col(key)), F.col("_parts").cast("bigint")).cast("int")).drop("_parts")


def open_index(spark, path: str, key: str, vector: str = "vector") -> VectorIndex:
    """Open an index written by ``build_index(path=...)``; nothing is read until it is searched."""
    cells = spark.read.schema(CELLS_SCHEMA).parquet(f"{path}/cells")
    vectors = spark.read.parquet(f"{path}/vectors")
    return VectorIndex(vectors=_with_parts(vectors, key, cells), cells=cells, key=key, vector=vector)


def table_index(rows: DataFrame, key: str, vector: str = "vector", rows_per_part: int = PART_ROWS) -> VectorIndex:
    """A table that already holds vectors (such as a synced index) as a searchable index of one cell around the
    origin, dealt into parts; nothing is written, one aggregate counts the rows. Keys must be unique."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda acc, x: acc + x * x))
    assigned = rows.withColumn(vector, F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull()) \
        .withColumns({"cell": F.lit(0), "cdist": norm})
    s = assigned.agg(F.count(F.lit(1)).alias("n"), F.max("cdist").alias("radius"), F.max(F.size(vector)).alias("dim")).first()
    n_parts = max(1, math.ceil(s["n"] / rows_per_part))
    cell = (0, [0.0] * (s["dim"] or 0), float(s["radius"] if s["n"] else -1.0), int(s["n"]), n_parts)
    cells = rows.sparkSession.createDataFrame([cell], CELLS_SCHEMA)
    return VectorIndex(vectors=_with_parts(assigned, key, cells), cells=cells, key=key, vector=vector)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix over Arrow's own buffer."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(lists), int(lengths[0]) if len(lengths) else 0)


def _probe_fn(qkey: str, qvec: str, cent: np.ndarray, rad: np.ndarray, nprobe: int, phase: int):
    c2 = (cent * cent).sum(axis=1)
    live = rad >= 0

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0 or not live.any():
                continue
            q = matrix(batch.column(qvec))
            s = q @ cent.T
            d2 = np.where(live[None, :], c2[None, :] - 2.0 * s, np.inf)
            order = np.argsort(d2, axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(q), 0), axis=1)
            if phase == 1:
                keep = (rank < nprobe) & live[None, :]
            else:
                qn = np.sqrt((q * q).sum(axis=1))
                bound = s + qn[:, None] * np.maximum(rad, 0)[None, :]
                thr = batch.column("thr").to_numpy(zero_copy_only=False)
                keep = (rank >= nprobe) & live[None, :] & (bound >= thr[:, None] - BOUND_SLACK)
            ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype("int32")
            cells = pa.ListArray.from_arrays(ends, np.nonzero(keep)[1].astype("int32"))
            yield pa.RecordBatch.from_arrays([batch.column(qkey), batch.column(qvec), cells], names=[qkey, qvec, "cells"])
    return probe


def _asked(queries: DataFrame, qkey: str, qvec: str, arrays, nprobe: int, phase: int) -> DataFrame:
    """(qkey, qvec, cells): one row per query with the cells it visits."""
    cent, rad = arrays
    queries = queries.filter(F.col(qvec).isNotNull())       # no vector, nothing to search for
    fields = [queries.schema[qkey], queries.schema[qvec], T.StructField("cells", T.ArrayType(T.IntegerType()))]
    src = queries.select(qkey, qvec, *(["thr"] if phase == 2 else []))
    return src.mapInArrow(_probe_fn(qkey, qvec, cent, rad, nprobe, phase), T.StructType(fields))


def _visits(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per query and cell it visits, with the number of the cell's parts (``_parts``) and rows (``_rows``)."""
    sized = cells.select("cell", F.col("n_parts").alias("_parts"), F.col("n").alias("_rows"))
    return asked.withColumn("cell", F.explode("cells")).drop("cells").join(sized, "cell")


def _probe(queries: DataFrame, qkey: str, qvec: str, arrays, cells: DataFrame, nprobe: int, phase: int) -> DataFrame:
    """(cell, qkey, qvec, _parts, _rows): one row per query and cell it visits."""
    # read for the per-cell counts and for the scan: written once, a row per query and not per visit
    return _visits(materialize(_asked(queries, qkey, qvec, arrays, nprobe, phase), "probes"), cells)


QUERY_BLOCK = 512            # queries and
ROW_BLOCK = 2048             # index rows of one matrix multiply inside a task
QUERY_CHUNK_ROWS = 65_536    # queries of a chunk of one cell at most: what a task holds of the queries
SMALL_CHUNK_ROWS = 1024      # no chunk is cut smaller to give all tasks work
GROUPS = 64                  # groups that keep the tasks busy: more of them only send the index more often
PAIRS = 1 << 14              # (query, row) pairs whose vectors are gathered at once
DENSE = 16                   # a tile of which more than one in so many pairs is asked for is scored whole
RANK_DECIMALS = 10           # scores are ranked at this precision, so summation order never reorders ties


def own_rows(qk: pa.ChunkedArray, dk: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) with the same key, sorted by query."""
    q, d = qk.to_pandas(), dk.to_pandas()
    if (q.dtype == object) != (d.dtype == object):
        return np.zeros(0, int), np.zeros(0, int)
    pairs = pd.DataFrame({"k": q, "i": np.arange(len(q))}).merge(pd.DataFrame({"k": d, "j": np.arange(len(d))}), on="k").sort_values("i")
    return pairs["i"].to_numpy(), pairs["j"].to_numpy()


def tiles(qm: np.ndarray, dm: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None):
    """(first query, first row, scores) of bounded blocks, all rows of one block of queries in turn; a query's
    own row scores minus infinity."""
    for q0 in range(0, len(qm), QUERY_BLOCK):
        mine = None
        if own is not None:
            a, b = np.searchsorted(own[0], [q0, q0 + QUERY_BLOCK])
            mine = own[0][a:b] - q0, own[1][a:b]
        for d0 in range(0, len(dm), ROW_BLOCK):
            score = qm[q0:q0 + QUERY_BLOCK] @ dm[d0:d0 + ROW_BLOCK].T
            if mine is not None:
                here = (mine[1] >= d0) & (mine[1] < d0 + ROW_BLOCK)
                score[mine[0][here], mine[1][here] - d0] = -np.inf
            yield q0, d0, score


def rounded(m: np.ndarray, other: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows in single precision, and their lengths; a row that is not finite becomes zero, of length 0. Double precision stays
    where products with rows of length ``other`` could leave the range."""
    fine = np.isfinite(m).all(axis=1)
    m = m if fine.all() else np.where(fine[:, None], m, 0.0)
    with np.errstate(over="ignore"):
        length = np.sqrt((m * m).sum(axis=1))
    return m.astype("float32" if length.max(initial=0) * max(other, 1.0) < 1e30 else float), length


def slack(qlength: np.ndarray, longest: float, dim: int) -> np.ndarray:
    """How far the product of rounded rows may lie from the product of the rows, per query."""
    with np.errstate(over="ignore", invalid="ignore"):
        off = np.finfo("float32").eps * (dim + 8) * qlength * longest + 1e-30
    return np.where(np.isnan(off), np.inf, off)


def reaching(score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the scores of a tile that are above the query's ``least``."""
    some = np.flatnonzero(score.max(axis=1) > least)
    at, cols = np.divmod(np.flatnonzero(score[some] > least[some, None]), score.shape[1])
    return some[at], cols


def dots(qm: np.ndarray, dm: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores of (query, row) pairs of one tile."""
    if len(rows) * DENSE > len(qm) * len(dm):
        return (qm @ dm.T)[rows, cols]
    return np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", qm[rows[a:a + PAIRS]], dm[cols[a:a + PAIRS]]) for a in range(0, len(rows), PAIRS)])


def best_rows(qm: np.ndarray, dm: np.ndarray, k: int, own=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows per query, ties at ``RANK_DECIMALS`` to the earlier row.

    After the first tile only rows that may beat the k-th best score so far are scored: single precision, with its slack, finds them."""
    out, least = [], np.zeros(0)
    rows, cols, vals = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    d32, dlen = rounded(dm)
    longest = dlen.max(initial=0)
    q32, qlen = rounded(qm, longest)
    off = slack(qlen, longest, qm.shape[1])
    for q0, d0, rough in tiles(q32, d32.astype(q32.dtype, copy=False), own):
        q, d = qm[q0:q0 + QUERY_BLOCK], dm[d0:d0 + ROW_BLOCK]
        if d0 == 0:
            score = q @ d.T
            score[~np.isfinite(score) | (rough == -np.inf)] = -np.inf
            at = max(score.shape[1] - k, 0)
            # rows of the first tile may tie with the k-th best; later ones tie only to lose
            least = np.partition(score, at, axis=1)[:, at] - 10.0 ** -RANK_DECIMALS
            r, c = np.nonzero(score > least[:, None])
            v = score[r, c]
        else:
            r, c = reaching(rough, least - off[q0:q0 + QUERY_BLOCK] - np.finfo("float32").eps * np.abs(least, where=np.isfinite(least), out=np.zeros(len(least))))
            v = dots(q, d, r, c)
            beats = v > least[r]
            r, c, v = r[beats], c[beats], v[beats]
        ok = np.isfinite(v)
        if ok.any() or d0 == 0:
            rows, cols = np.concatenate([rows, r[ok]]), np.concatenate([cols, c[ok] + d0])
            vals = np.concatenate([vals, v[ok]])
            ranked = np.round(vals, RANK_DECIMALS)
            order = np.lexsort((cols, -ranked, rows))
            rows = rows[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            order, rows, nth = order[nth < k], rows[nth < k], nth[nth < k]
            cols, vals, ranked = cols[order], vals[order], ranked[order]
            least[:] = -np.inf
            least[rows[nth == k - 1]] = ranked[nth == k - 1] + 0.4 * 10.0 ** -RANK_DECIMALS
        if d0 + ROW_BLOCK >= len(dm):
            out.append((rows + q0, cols, vals))
            rows, cols, vals = rows[:0], cols[:0], vals[:0]
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan_fn(qkey: str, key: str, k: int, exclude_self: bool):
    def scan(q: pa.Table, d: pa.Table) -> pa.Table:
        qk, dk = q.column(qkey), d.column(key)
        if q.num_rows == 0 or d.num_rows == 0:
            return pa.table({qkey: qk.slice(0, 0), "hit_key": dk.slice(0, 0), "score": pa.array([], pa.float64())})
        by_key = pc.sort_indices(dk)                # so that ties go to the smaller key
        dk = dk.take(by_key)
        own = own_rows(qk, dk) if exclude_self else None
        rows, cols, vals = best_rows(matrix(q.column("qvec")), matrix(d.column("_dvec"))[by_key.to_numpy()], k, own)
        return pa.table({qkey: qk.take(pa.array(rows)), "hit_key": dk.take(pa.array(cols)), "score": pa.array(vals)})
    return scan


def _query_chunks(probes: DataFrame, qkey: str, qvec: str) -> tuple[DataFrame, DataFrame]:
    """Probes dealt into the parts of their cell and chunks of the cell's queries, and (cell, _chunks, _splits) of every visited cell.
    Columns besides the query's stay.

    Where more groups than memory asks for keep the tasks busy, parts are split too (``_splits``), so that neither side is sent more often
    than it saves the other."""
    visited = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_parts").alias("_parts"), F.max("_rows").alias("_rows"))
    visited = materialize(visited, "probe-counts")
    work = visited.agg(F.sum(F.col("_n") * F.col("_parts"))).first()[0] or 0
    rows = min(QUERY_CHUNK_ROWS, max(SMALL_CHUNK_ROWS, math.ceil(work / GROUPS)))
    wanted, needed = F.ceil(F.col("_n") / rows), F.ceil(F.col("_n") / QUERY_CHUNK_ROWS)
    more = wanted / needed
    splits = F.floor(F.greatest(F.lit(1.0), F.least(more, F.sqrt(more * needed * F.col("_rows") / (F.col("_n") * F.col("_parts"))))))
    chunks = visited.select("cell", F.ceil(wanted / splits).cast("int").alias("_chunks"), splits.cast("int").alias("_splits"))
    p = probes.withColumnRenamed(qvec, "qvec").join(chunks, "cell").withColumn(
        "qchunk", F.pmod(F.xxhash64(F.col(qkey)), F.col("_chunks").cast("bigint")).cast("int"))
    p = p.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") * F.col("_splits") - 1)))
    return p.drop("_chunks", "_splits", "_parts", "_rows"), chunks


def _dealt(rows: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Index rows (cell, part, ``key``, ...) of the visited cells, in the split of their part, once for every chunk of the cell's queries."""
    # cells no query visits never enter the shuffle: the inner join leaves them out
    split = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.col("_splits").cast("bigint")).cast("int")
    rows = rows.join(chunks, "cell").withColumn("part", F.col("part") * F.col("_splits") + split)
    return rows.withColumn("qchunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks", "_splits")


def _candidates(probes: DataFrame, index: VectorIndex, qkey: str, qvec: str, exclude_self: bool,
                k: int) -> DataFrame:
    """Per-(cell, part, query chunk) best-k candidates: both sides are cogrouped on the
    cell key and each group is scored tile by tile; only k rows per query leave the task.

    Query chunks are sized from the probe counts (an aggregate by cell, joined to both sides), so an index part is
    replayed only as many times as its own cell's queries need, and a hot cell's queries are split over many tasks."""
    p, chunks = _query_chunks(probes, qkey, qvec)
    v = _dealt(index.vectors.select(index.key, F.col(index.vector).alias("_dvec"), "cell", "part"), chunks, index.key)
    schema = T.StructType([probes.schema[qkey], T.StructField("hit_key", index.vectors.schema[index.key].dataType),
                           T.StructField("score", T.DoubleType())])
    g = ["cell", "part", "qchunk"]
    return p.groupBy(*g).cogroup(v.groupBy(*g)).applyInArrow(_scan_fn(qkey, index.key, k, exclude_self), schema)


def _top(c: DataFrame, qkey: str, k: int) -> DataFrame:
    w = Window.partitionBy(qkey).orderBy(F.round("score", RANK_DECIMALS).desc(), F.col("hit_key").asc())
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_ann(queries: DataFrame, index: VectorIndex, k: int = 3, nprobe: int = 4, qkey: str = "qid",
             qvec: str = "qvec", exclude_self: bool = False) -> DataFrame:
    """Approximate k nearest by dot product, visiting the ``nprobe`` nearest cells (op 18).
    Output: qkey, rank, hit_key, score."""
    arrays = index.cell_arrays()
    c = _candidates(_probe(queries, qkey, qvec, arrays, index.cells, nprobe, 1), index, qkey, qvec, exclude_self, k)
    return _top(c, qkey, k).select(qkey, "rank", "hit_key", "score")


def topk_join(queries: DataFrame, index: VectorIndex, k: int = 3, nprobe: int = 1, qkey: str = "qid",
              qvec: str = "qvec", exclude_self: bool = False) -> DataFrame:
    """Exact k best index rows per query by dot product (op 17); ties by key.
    Output: qkey, rank, hit_key, score."""
    arrays = index.cell_arrays()
    live_cells = int((arrays[1] >= 0).sum())
    if nprobe >= live_cells:
        # every non-empty cell is visited in the first pass: that pass is already exact
        return topk_ann(queries, index, k, nprobe, qkey, qvec, exclude_self)
    # the query vectors feed both passes: materialise them once in the checkpoint folder
    queries = materialize(queries.select(qkey, qvec), "queries")
    first = _top(_candidates(_probe(queries, qkey, qvec, arrays, index.cells, nprobe, 1), index, qkey, qvec, exclude_self, k), qkey, k)
    first = materialize(first, "first-hits")            # k rows per query, read for the thresholds and the result
    thr = first.groupBy(qkey).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NO_THRESHOLD)).alias("thr"))
    q2 = queries.join(thr, qkey, "left").fillna({"thr": NO_THRESHOLD})
    rest = _candidates(_probe(q2, qkey, qvec, arrays, index.cells, nprobe, 2), index, qkey, qvec, exclude_self, k)
    allc = first.select(qkey, "hit_key", "score").unionByName(rest)
    return _top(allc, qkey, k).select(qkey, "rank", "hit_key", "score")


def project_hits(hits: DataFrame, source: DataFrame, columns: list[str], key: str,
                 hit_key: str = "hit_key") -> DataFrame:
    """Attach the asked columns of each hit, always with the primary key (op 19).
    Only ranked hits (k per query) are joined back to the wide source rows."""
    cols = list(columns) + ([key] if key not in columns else [])
    # k rows per query against the whole corpus: the hits are the broadcast side, the
    # corpus rows (whole texts) are streamed past them, never shuffled
    return left_lookup(hits, source.select(*cols), hit_key, key, "hits").drop(hit_key)


def with_empty_default(queries: DataFrame, hits: DataFrame, qkey: str, message: str,
                       out: str = "message") -> DataFrame:
    """Hits per query, or one row carrying ``message`` for a query without hits (op 16)."""
    j = queries.select(qkey).join(hits, qkey, "left")
    return j.withColumn(out, F.when(F.col("rank").isNull(), F.lit(message)))
