"""Product-quantised residual codes beside the cells of a vector index, scanned before the vectors (op 18).

A coded row is ``(key, cell, part, code, err)``: the vector less its cell's centroid, cut into runs of ``part_dims``
components, each run replaced by the number of its nearest codebook entry (one byte), and the length of what the code
leaves out. A scan shuffles these bytes in place of the vectors (64 doubles become 32 bytes).

``topk_coded`` first scans the nearest cell of each query; its k-th best score there is the query's threshold. The other visited
cells are then scanned with it: a row's true score lies within ``|q| * err`` of its coded score, so a row whose upper end is below the
threshold cannot be a hit. What survives is not a number but a bound; survivors are scored by their vectors in the task that
ruled out the others (the rows of a cell come with their codes and vectors), and only the k best of a query leave it, however many
survive. The result equals ``vectors.topk_ann`` with the same cells; no candidate is lost to the codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .vectors import BOUND_SLACK, NO_THRESHOLD, QUERY_BLOCK, RANK_DECIMALS, ROW_BLOCK, VectorIndex, _asked, _dealt, _query_chunks, _top, _visits, dots, matrix, own_rows, \
    reaching, rounded, slack, tiles

ENTRIES = 256                # a code of one part is one byte
FIT_ROWS = 8192              # rows the codebooks are fitted on, at most; every row is coded
FIT_ROUNDS = 8


@dataclass
class CodedIndex:
    index: VectorIndex
    codes: DataFrame         # key, cell, part, code, err
    books: list[np.ndarray]  # per run of components: entries x width, ENTRIES rows at most


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.map(lambda v: np.asarray(v, dtype=float)).to_numpy())


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1)[None, :] - 2.0 * (x @ book.T)).argmin(axis=1)


def _starts(dim: int, part_dims: int) -> list[int]:
    return list(range(0, dim, part_dims))


def fit_books(index: VectorIndex, centers: np.ndarray, part_dims: int, rows: int, seed: int) -> list[np.ndarray]:
    """Codebooks of all runs, one group a run, fitted by Lloyd's rounds on the residuals of the ``rows`` rows with the smallest
    key hashes."""
    starts = _starts(centers.shape[1], part_dims)
    sample = index.vectors.select(index.key, "cell", F.col(index.vector).alias("v")) \
        .orderBy(F.xxhash64(F.lit(seed), F.col(index.key)), index.key).limit(rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                rest = _matrix(pdf["v"]) - centers[pdf["cell"].to_numpy()]
                for run, at in enumerate(starts):
                    yield pd.DataFrame({"run": run, "x": list(rest[:, at:at + part_dims])})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        run, x = int(pdf["run"].iloc[0]), _matrix(pdf["x"])
        distinct = np.unique(x, axis=0)          # sorted, so the start does not depend on the order of the rows
        x = x[np.lexsort(x.T)]
        book = distinct[np.random.default_rng(seed).permutation(len(distinct))[:ENTRIES]]
        for _ in range(FIT_ROUNDS):
            at = _nearest(x, book)
            n = np.bincount(at, minlength=len(book))
            sums = np.stack([np.bincount(at, x[:, d], len(book)) for d in range(x.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        return pd.DataFrame({"run": run, "entry": np.arange(len(book)), "x": list(book)})

    fitted = sample.mapInPandas(cut, "run int, x array<double>").groupBy("run").applyInPandas(fit, "run int, entry int, x array<double>")
    books: list[list] = [[] for _ in starts]
    for r in sorted(fitted.collect()):           # a codebook: ENTRIES rows a run at most
        books[r["run"]].append(r["x"])
    return [np.array(b, dtype=float).reshape(len(b), -1) for b in books]


def add_codes(index: VectorIndex, part_dims: int = 2, fit_rows: int = FIT_ROWS, seed: int = 7, path: str | None = None) -> CodedIndex:
    """Codes of every row of ``index``, written once (to ``path`` or as a table in the shared folder).

    ``part_dims`` components share a byte; the last run may be narrower. The codebooks are fitted on ``fit_rows`` rows at
    most, which decides how tight the bounds are, never what is found. Equal vectors get equal codes; an empty index
    gives no codes."""
    centers, _ = index.cell_arrays()
    books = fit_books(index, centers, part_dims, fit_rows, seed)
    starts = _starts(centers.shape[1], part_dims)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            rest = _matrix(pdf["v"]) - centers[pdf["cell"].to_numpy()]
            code = np.empty((len(pdf), len(books)), dtype=np.uint8)
            left = np.zeros(len(pdf))
            for run, (at, book) in enumerate(zip(starts, books)):
                x = rest[:, at:at + part_dims]
                code[:, run] = _nearest(x, book)
                left += ((x - book[code[:, run]]) ** 2).sum(axis=1)
            out = pdf.drop(columns="v")
            out["code"] = [row.tobytes() for row in code]
            out["err"] = np.sqrt(left)
            yield out

    rows = index.vectors.select(index.key, "cell", "part", F.col(index.vector).alias("v"))
    schema = T.StructType([*rows.drop("v").schema.fields, T.StructField("code", T.BinaryType()), T.StructField("err", T.DoubleType())])
    codes = rows.mapInPandas(encode, schema)
    if path is None:
        return CodedIndex(index, materialize(codes, "codes"), books)
    codes.write.mode("overwrite").partitionBy("cell").parquet(path)
    return CodedIndex(index, index.cells.sparkSession.read.schema(schema).parquet(path), books)


def decode(cells: np.ndarray, codes: pd.Series, centers: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for: centroid plus one entry a run."""
    code = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), len(books))
    return centers[cells] + np.concatenate([book[code[:, run]] for run, book in enumerate(books)], axis=1)


def _upper(qm: np.ndarray, near: np.ndarray, err: np.ndarray, own):
    """``tiles`` of the scores that rows may have at most: the coded score plus ``|q| * err``, as one more component, in single
    precision; and how far those may be off, per query. A row whose code says nothing may have any score."""
    known = np.isfinite(err) & np.isfinite(near).all(axis=1)
    d, length = rounded(np.column_stack([np.where(known[:, None], near, 0.0), np.where(known, err, 0.0)]))
    longest = length.max(initial=0)
    q, qlen = rounded(np.column_stack([qm, np.sqrt((qm * qm).sum(axis=1))]), longest)

    def marked():
        for q0, d0, most in tiles(q, d.astype(q.dtype, copy=False), own):
            if not known[d0:d0 + ROW_BLOCK].all():
                most[(most > -np.inf) & ~known[d0:d0 + ROW_BLOCK]] = np.inf
            yield q0, d0, most
    return marked(), slack(qlen, longest, q.shape[1]) + BOUND_SLACK


def _reaching(qm: np.ndarray, near: np.ndarray, err: np.ndarray, bound: np.ndarray, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score that the row may have at most) of the rows that may reach the bound of their query."""
    found = []
    upper, off = _upper(qm, near, err, own)
    for q0, d0, most in upper:
        r, c = reaching(most, _below(bound[q0:q0 + QUERY_BLOCK], off[q0:q0 + QUERY_BLOCK]))
        found.append((r + q0, c + d0, most[r, c].astype(float)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _below(bound: np.ndarray, off: np.ndarray) -> np.ndarray:
    return bound - off - np.finfo("float32").eps * np.abs(bound)


def _kth(qm: np.ndarray, dm: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """The least true score of the ``k`` rows of a tile that may score most: a query has k rows that reach it."""
    if most.shape[1] < k:
        return np.full(len(most), NO_THRESHOLD)
    cols = np.argpartition(most, most.shape[1] - k, axis=1)[:, -k:]
    rows = np.repeat(np.arange(len(most)), k)
    true = dots(qm, dm, rows, cols.ravel()).reshape(-1, k)
    return np.where((np.isfinite(true) & np.isfinite(np.take_along_axis(most, cols, 1))).all(axis=1), true.min(axis=1), NO_THRESHOLD)


def best_coded(qm: np.ndarray, near: np.ndarray, err: np.ndarray, dm: np.ndarray, k: int, bound: np.ndarray,
               own=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``vectors.best_rows`` of the rows that may reach their query's ``bound``: those that the codes do not rule out are scored by
    ``dm``, and the k-th best score so far rules out more of the next ones."""
    out = []
    upper, off = _upper(qm, near, err, own)
    for q0, d0, most in upper:
        q, d = qm[q0:q0 + QUERY_BLOCK], dm[d0:d0 + ROW_BLOCK]
        if d0 == 0:
            rows, cols, vals = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            least = np.maximum(bound[q0:q0 + QUERY_BLOCK], _kth(q, d, most, k))
        r, c = reaching(most, _below(least, off[q0:q0 + QUERY_BLOCK]))
        v = dots(q, d, r, c)
        ok = np.isfinite(v)
        rows, cols, vals = np.concatenate([rows, r[ok]]), np.concatenate([cols, c[ok] + d0]), np.concatenate([vals, v[ok]])
        order = np.lexsort((cols, -np.round(vals, RANK_DECIMALS), rows))
        nth = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
        order, nth = order[nth < k], nth[nth < k]
        rows, cols, vals = rows[order], cols[order], vals[order]
        last = rows[nth == k - 1]
        least[last] = np.maximum(least[last], vals[nth == k - 1])
        if d0 + ROW_BLOCK >= len(near):
            out.append((rows + q0, cols, vals))
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan_codes(qkey: str, key: str, k: int, exclude_self: bool, centers: np.ndarray, books: list[np.ndarray], scored: bool):
    """A scan of one group: every row whose code reaches the query's ``_bound``, or (``scored``) the ``k`` best of them by their vectors."""
    def scan(q: pa.Table, d: pa.Table) -> pa.Table:
        qk, d = q.column(qkey), d.take(pc.sort_indices(d.column(key)))      # so that ties go to the smaller key
        dk = d.column(key)
        if q.num_rows == 0 or d.num_rows == 0:
            rows = cols = np.zeros(0, int)
            score = np.zeros(0)
        else:
            qm, near = matrix(q.column("qvec")), decode(d.column("cell").to_numpy(), d.column("code").to_pylist(), centers, books)
            err, bound = d.column("err").to_numpy(), q.column("_bound").to_numpy()
            own = own_rows(qk, dk) if exclude_self else None
            rows, cols, score = best_coded(qm, near, err, matrix(d.column("_dvec")), k, bound, own) if scored else _reaching(qm, near, err, bound, own)
        at = pa.array(cols)
        return pa.table({qkey: qk.take(pa.array(rows)), "hit_key": dk.take(at), "cell": d.column("cell").take(at), "score": pa.array(score)})
    return scan


def _scanned(asked: DataFrame, coded: CodedIndex, k: int, qkey: str, exclude_self: bool, centers: np.ndarray, scored: bool) -> DataFrame:
    """(qkey, hit_key, cell, score) that a scan of the cells of ``asked`` (qkey, qvec, cells, _bound) leaves."""
    index, rows = coded.index, coded.codes
    p, chunks = _query_chunks(_visits(asked, index.cells), qkey, "qvec")
    if scored:
        rows = rows.join(index.vectors.select("cell", index.key, F.col(index.vector).alias("_dvec")), ["cell", index.key])
    rows = _dealt(rows, chunks, index.key)
    schema = T.StructType([p.schema[qkey], T.StructField("hit_key", rows.schema[index.key].dataType),
                           T.StructField("cell", T.IntegerType()), T.StructField("score", T.DoubleType())])
    g = ["cell", "part", "qchunk"]
    return p.groupBy(*g).cogroup(rows.groupBy(*g)).applyInArrow(_scan_codes(qkey, index.key, k, exclude_self, centers, coded.books, scored), schema)


def _bounded(queries: DataFrame, coded: CodedIndex, k: int, nprobe: int, qkey: str, qvec: str, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """The k best rows of each query's nearest cell, and the queries (qkey, qvec, cells, _bound, _nearest) with their k-th score there."""
    arrays = coded.index.cell_arrays()
    queries = queries.select(qkey, F.col(qvec).cast("array<double>").alias("qvec"))
    nearest = materialize(_asked(queries, qkey, "qvec", arrays, 1, 1).withColumn("_bound", F.lit(NO_THRESHOLD)), "coded-nearest")
    first = materialize(_top(_scanned(nearest, coded, k, qkey, exclude_self, arrays[0], True), qkey, k).drop("rank"), "coded-first")
    bound = first.groupBy(qkey).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NO_THRESHOLD)).alias("_bound"))
    asked = _asked(queries, qkey, "qvec", arrays, nprobe, 1).join(bound, qkey, "left").fillna({"_bound": NO_THRESHOLD})
    asked = asked.join(nearest.select(qkey, F.get("cells", 0).alias("_nearest")), qkey)
    return first, materialize(asked, "coded-bounds")


def survivors(queries: DataFrame, coded: CodedIndex, k: int, nprobe: int, qkey: str, qvec: str, exclude_self: bool = False) -> DataFrame:
    """(qkey, hit_key, cell) of every row of the visited cells that its code does not rule out."""
    asked = _bounded(queries, coded, k, nprobe, qkey, qvec, exclude_self)[1].drop("_nearest")
    return _scanned(asked, coded, k, qkey, exclude_self, coded.index.cell_arrays()[0], False).drop("score")


def topk_coded(queries: DataFrame, coded: CodedIndex, k: int = 3, nprobe: int = 4, qkey: str = "qid", qvec: str = "qvec",
               exclude_self: bool = False) -> DataFrame:
    """k best rows of the ``nprobe`` nearest cells by dot product, codes first, then the survivors by their vectors; the same
    rows as ``vectors.topk_ann``. Query keys are unique; queries without a vector have no hits.
    Output: qkey, rank, hit_key, score."""
    first, asked = _bounded(queries, coded, k, nprobe, qkey, qvec, exclude_self)
    rest = asked.withColumn("cells", F.array_remove("cells", F.col("_nearest"))).drop("_nearest")
    found = first.unionByName(_scanned(rest, coded, k, qkey, exclude_self, coded.index.cell_arrays()[0], True))
    return _top(found, qkey, k).select(qkey, "rank", "hit_key", "score")
