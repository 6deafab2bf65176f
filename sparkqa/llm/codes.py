"""Vector code compression: product quantisation over Hilbert-sorted flat blocks, in exact integers.

Vectors become integers and are cut into equal parts; each part position has a codebook of at most
``ENTRIES`` entries, refined by rounds of assignment and averaging. Tasks hold the vectors in chunks. Inside a
chunk the parts of each position are sorted along a Hilbert curve and stored flat in blocks of
``BLOCK`` neighbours, each with its min/max box and its componentwise sum. Nothing is shuffled for it.

A round sends the codebooks to the chunks. The least distance an entry can have to a block's box, against the largest one that
the best entry can have, leaves the block a shortlist. A shortlist of one takes the whole block by its
sum and count, without looking at its parts; longer ones are evaluated by small integer kernels, blocks of like shortlists
together. Every task adds up one row per entry, so a round brings at most parts x entries rows to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .curves import hilbert_keys

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CHUNK = 32_768  # vectors of one chunk, about 11 MB at 64 components
BLOCK = 16
CELLS = 1 << 20  # distances computed at once

Books = list[np.ndarray]
Flat = dict[str, np.ndarray]


def component_limit(width: int) -> int:
    """Largest absolute component at which neither a distance nor a sum of distances can leave 63 bits."""
    return 1 << max(1, (62 - max(width - 1, 1).bit_length()) // 2 - 1)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held inside the component limit."""
    limit = component_limit(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -limit, limit).astype(np.int64)


def flat_blocks(points: np.ndarray) -> Flat:
    """Hilbert order of the rows of ``points`` and the boxes and sums of its blocks."""
    n, width = points.shape
    low, high = points.min(0), points.max(0)
    curved = np.argsort(low - high, kind="stable")[:16]  # the widest components carry the curve
    bits = max(1, min(9, 62 // max(len(curved), 1)))
    spread = np.maximum(high - low, 1)[curved].astype(np.float64)
    cells = ((points[:, curved] - low[curved]) / spread * ((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(hilbert_keys(cells, bits), kind="stable")
    sorted_points, starts = points[order], np.arange(0, n, BLOCK)
    return {"places": order.astype(np.int32), "points": sorted_points.astype(np.int32), "low": np.minimum.reduceat(sorted_points, starts).astype(np.int32),
            "high": np.maximum.reduceat(sorted_points, starts).astype(np.int32), "sums": np.add.reduceat(sorted_points, starts)}


FLAT = {"places": np.int32, "points": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}


def unpack(stored: dict[str, bytes], width: int) -> Flat:
    flat = {k: np.frombuffer(stored[k], kind) for k, kind in FLAT.items()}
    return {k: v if k == "places" else v.reshape(-1, width).astype(np.int64) for k, v in flat.items()}


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): True where the entry may be nearest to some point of the block's box, ties included."""
    out = np.empty((len(low), len(book)), bool)
    step = max(1, CELLS // book.size)
    for at in range(0, len(low), step):
        lo, hi = low[at:at + step, None], high[at:at + step, None]
        near = np.maximum(np.maximum(lo - book, book - hi), 0)
        far = np.maximum(np.abs(book - lo), np.abs(hi - book))
        out[at:at + step] = (near * near).sum(2) <= (far * far).sum(2).min(1, keepdims=True)
    return out


def evaluated(flat: Flat, book: np.ndarray, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, nearest entry, squared distance) of the blocks whose shortlist is in ``among``, those of like length together."""
    n = len(flat["points"])
    lengths = among.sum(1)
    for width in [1 << i for i in range(ENTRIES.bit_length() + 8)]:
        blocks = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        step = max(1, CELLS // (BLOCK * width))
        for at in range(0, len(blocks), step):
            some = blocks[at:at + step]
            # entries in ascending order, so the first of equal distances is the lowest index; places left over repeat the first
            entry = np.argsort(~among[some], axis=1, kind="stable")[:, :width]
            entry = np.where(np.arange(entry.shape[1]) < lengths[some, None], entry, entry[:, :1])
            rows = some[:, None] * BLOCK + np.arange(BLOCK)
            points, entries = flat["points"][np.minimum(rows, n - 1)], book[entry]
            d = np.zeros((len(some), BLOCK, entry.shape[1]), np.int64)
            for i in range(points.shape[2]):
                gap = points[:, :, None, i] - entries[:, None, :, i]
                d += gap * gap
            best = d.argmin(2)
            real = rows < n
            yield rows[real], np.take_along_axis(entry, best, 1)[real], np.take_along_axis(d, best[:, :, None], 2)[:, :, 0][real]


def block_sums(flat: Flat, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the parts nearest to each entry."""
    count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    among, n = shortlists(flat["low"], flat["high"], book), len(flat["points"])
    alone = among.sum(1) == 1
    sizes = np.minimum(BLOCK, n - BLOCK * np.arange(len(among)))
    only = among.argmax(1)
    np.add.at(count, only[alone], sizes[alone])
    np.add.at(total, only[alone], flat["sums"][alone])
    for rows, nearest, _ in evaluated(flat, book, among & ~alone[:, None]):
        np.add.at(count, nearest, 1)
        np.add.at(total, nearest, flat["points"][rows])
    return count, total


def assign(flat: Flat, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of the parts, in the order of the chunk's vectors."""
    code, error = np.empty(len(flat["points"]), np.uint8), np.empty(len(flat["points"]), np.int64)
    for rows, nearest, d in evaluated(flat, book, shortlists(flat["low"], flat["high"], book)):
        code[flat["places"][rows]], error[flat["places"][rows]] = nearest, d
    return code, error


def chunk_task(width: int):
    """Vectors of a task as chunks: one row each, with the ids, the labels and the flat blocks of every part position."""
    def chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        n, part = rows.num_rows, width // PARTS
        x = integers(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, width))
        flats = [flat_blocks(x[:, p * part:(p + 1) * part]) for p in range(PARTS)]
        stored = pa.array([[{k: v.tobytes() for k, v in f.items()} for f in flats]],
                          pa.list_(pa.struct([(k, pa.binary()) for k in FLAT])))
        whole = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*whole, stored], ["ids", "labels", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                taken = batch.slice(at, CHUNK - rows)
                held.append(taken)
                rows, at = rows + taken.num_rows, at + taken.num_rows
                if rows == CHUNK:
                    yield chunk(held)
                    held, rows = [], 0
        if rows:
            yield chunk(held)
    return run


def sum_task(books: Books, part: int):
    """Sums one round over the chunks of a task: (position, entry, n, sums), at most one row per entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for p, stored in enumerate(batch.column(0)[row].as_py()):
                    count, total = block_sums(unpack(stored, part), books[p])
                    counts[p] += count
                    totals[p] += total
        found = [(p, e, int(counts[p][e]), totals[p][e].tolist()) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        if found:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["position", "entry", "n", "sums"])
    return run


def code_task(books: Books, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = [assign(unpack(stored, part), book) for stored, book in zip(batch.column("parts")[row].as_py(), books)]
                digits = np.stack([c for c, _ in found], 1).tobytes().hex()
                code = pa.array([digits[at:at + 2 * PARTS] for at in range(0, len(digits), 2 * PARTS)])
                error = pa.array(sum(e for _, e in found))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, batch.column("labels")[row].values, code, error],
                                                 ["id", "label", "code", "error"])
    return run


def finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def learn(chunks: DataFrame, books: Books, part: int, rounds: int = ROUNDS) -> Books:
    """Codebooks after ``rounds`` of exact assignment and averaging (floor of the mean; unused entries stay)."""
    for _ in range(rounds):
        sums = chunks.select("parts").mapInArrow(sum_task(books, part), "position int, entry int, n long, sums array<long>")
        found = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(part)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in found.collect():
            books[r.position][r.entry] = [s // r.n for s in r.sums]
    return books


def codebook_digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 rounds: int = ROUNDS) -> DataFrame:
    """id, ``code`` (two hex digits per part), ``error`` (squared distance to the entries, in units of 1/SCALE),
    ``label_error`` (errors summed over equal labels) and ``codebooks_sha256`` of every vector that can be coded.

    Left out: vectors that are null, empty or hold null or non-finite components, and those whose length isn't the commonest (the
    longer of two as common). That length must be a multiple of PARTS, else ValueError. The codebooks start
    from the rows of smallest id (null ids last, ties by vector); with fewer rows than ENTRIES they have fewer entries. Components beyond
    ``component_limit`` (over half a million at 64 components) count as that limit, as squares would leave 64 bits. Null labels are one
    label; a label's sum beyond 64 bits is null. Repeated ids and vectors are rows like any other, and the same vector gets
    the same code anywhere; an empty table gives an empty result. Other columns, whatever their names, are not read. Texts play no part."""
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")) \
        .where(finite("vector") & (F.size("vector") > 0))
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    spark = rows.sparkSession
    common = kept.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        codes, books = spark.createDataFrame([], schema), []
    else:
        width = common.width
        if width % PARTS:
            raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
        part = width // PARTS
        kept = kept.where(F.size("vector") == width)
        first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
        start = integers(np.array([r.vector for r in first], np.float64))
        stored = T.ArrayType(T.StructType([T.StructField(k, T.BinaryType()) for k in FLAT]))
        chunk_schema = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])),
                                     T.StructField("parts", stored)])
        chunks = materialize(kept.select("id", "label", "vector").mapInArrow(chunk_task(width), chunk_schema), "code-chunks")
        books = learn(chunks, [start[:, p * part:(p + 1) * part] for p in range(PARTS)], part, rounds)
        codes = materialize(chunks.mapInArrow(code_task(books, part), schema), "codes")
    sums = materialize(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
