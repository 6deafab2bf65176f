"""Conversation prefix trie: every distinct opening of the conversations, counted exactly.

A prefix is known by a 128-bit digest, the exclusive or of the digests of its (depth, turn) pairs, so that a
running aggregate gives the digests of all prefixes and a turn's own digest leads back to the parent's.

Screening: tasks enter the digests of their prefixes in a count-min sketch (two rows of counters that stop at two), the
sketches are added up page by page, and the pages come back as bitmaps of the counters that reached two. A prefix with a
counter of one belongs to one conversation for certain: its node is emitted where its turn lies, with no shuffle. Only prefixes that may
be shared are shuffled and grouped exactly; a wrongly suspected one turns out to have one member there.

Sums over subtrees need no walk down the trie: every node is charged to its smallest member, which also
passes through all nodes above it, so a subtree's sum is a sum over members, less what the
smallest member owes to nodes further up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import with_position
from .common import SPACE, crc_of_id, materialize, parallelism

STRETCH = 4096  # rows of one key that a window sums in one task
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27  # counters of a sketch row; at most 2 x 16 MB of bitmaps are sent out
CELLS_PER_PREFIX = 4
PAGE = 1 << 16
FLUSH = 1 << 21  # prefixes a task sketches before it writes its pages
IDS_PER_RUN = 8192
GROUP, OPENINGS = 20, 4
SPACES = r"[\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def word_count(text: str) -> Column:
    trimmed = F.btrim(F.col(text), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def half(digest: Column, at: int) -> Column:
    """16 hex digits of a digest as a signed long."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def turn_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv, depth, a, b, words): every turn's place in its conversation from 1, its digest and words, written once.

    Turns go by turn number, null first, those of one number by digest. Null role or text is
    empty; turns of no conversation (null id) are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(conv_col).isNotNull()) \
        .select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")) \
        .select("conv", "turn", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
                word_count("text").alias("words")) \
        .select("conv", "turn", half(F.col("digest"), 1).alias("a"), half(F.col("digest"), 17).alias("b"), "words")
    # written before they are sorted: sampling the order would digest every text twice
    placed = with_position(materialize(turns, "turn-marks"), "conv", ["turn", "a", "b"], "depth")
    return materialize(placed.select("conv", (F.col("depth") + 1).alias("depth"), "a", "b", "words"), "turn-digests")


def lend_openings(turns: DataFrame, group: int = GROUP, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the opening of the first of their ``group`` ids: (turns, conversations).

    Conversation c gets the first h turns of conversation c - c % group (all if fewer, none if absent), then its own
    after its first h; h is the CRC-32 of c modulo ``openings``. The second frame has (conv, length), turnless ones too."""
    taken = F.pmod(crc_of_id("conv"), F.lit(openings))
    base = F.col("conv") - F.col("conv") % group
    heads = turns.where((F.col("conv") % group == 0) & (F.col("depth") < openings)).withColumnRenamed("conv", "base")
    have = heads.groupBy("base").agg(F.count(F.lit(1)).alias("have"))
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"base": base, "h": taken})
    lent = F.least("h", F.coalesce("have", F.lit(0)))
    convs = materialize(own.join(have, "base", "left").select(
        "conv", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "rebuilt-conversations")
    openings_ = convs.select("conv", "base", "lent").join(heads, "base").where("depth <= lent").select("conv", "depth", "a", "b", "words")
    # own turns move up where the lender has fewer turns than were asked for
    short = materialize(convs.where("lent < h").select("conv", (F.col("h") - F.col("lent")).alias("gap")), "short-openings")
    rest = turns.where(F.col("depth") > taken).join(short, "conv", "left") \
        .select("conv", (F.col("depth") - F.coalesce("gap", F.lit(0))).alias("depth"), "a", "b", "words")
    return openings_.unionByName(rest), convs.select("conv", "length")


def running(rows: DataFrame, key: str, order: str, sums: dict[str, str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with running aggregates (output name: aggregate) in ``order`` (1, 2, ..., unique per key, gaps allowed), for keys
    of any size: a window sums a stretch of ``STRETCH`` places, and what the stretches before it gave is joined to it.
    The second frame has (key, stretch, columns) of the keys with several stretches only. ``rows`` should be a written table."""
    cut = rows.withColumn("stretch", F.expr(f"({order} - 1) div {STRETCH}"))
    inside = Window.partitionBy(key, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = cut.withColumns({name: F.expr(agg).over(inside) for name, agg in sums.items()}) \
        .withColumn("ends", F.lead(order).over(Window.partitionBy(key, "stretch").orderBy(order)).isNull())
    long_keys = cut.where("stretch > 0").select(key).distinct()
    totals = cut.join(long_keys, key, "left_semi").groupBy(key, "stretch").agg(*[F.expr(a).alias(f"{n}_before") for n, a in sums.items()])
    ahead = Window.partitionBy(key).orderBy("stretch")
    before = totals.select(key, "stretch", F.lead("stretch").over(ahead).isNotNull().alias("more"), *[
        F.expr(agg.split("(")[0] + f"({name}_before)").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{name}_before")
        for name, agg in sums.items()])
    return partial, materialize(before, label)


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv, depth, p1, p2, q1, q2, words, last) of every turn: digests of the prefix and of its parent, written."""
    marked = materialize(turns.select("conv", "depth", F.xxhash64(F.lit(1), "depth", "a", "b").alias("g1"),
                                      F.xxhash64(F.lit(2), "depth", "b", "a").alias("g2"), "words"), "turns")
    partial, before = running(marked, "conv", "depth", {"p1": "bit_xor(g1)", "p2": "bit_xor(g2)"}, "long-conversations")
    joined = partial.join(before, ["conv", "stretch"], "left")
    for p, g, q in (("p1", "g1", "q1"), ("p2", "g2", "q2")):
        joined = joined.withColumn(p, F.col(p).bitwiseXOR(F.coalesce(f"{p}_before", F.lit(0)))).withColumn(q, F.col(p).bitwiseXOR(F.col(g)))
    last = F.col("ends") & ~F.coalesce("more", F.lit(False))
    return materialize(joined.select("conv", "depth", "p1", "p2", "q1", "q2", "words", last.alias("last")), "prefixes")


def sketch_task(cells: int):
    """Pages of a task's sketch: offsets of counters met once and of those met again (both sorted, 16 bits each)."""
    def pages(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.flatnonzero(np.diff(found >> 16, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(found)]):
            offsets = (found[low:high] & (PAGE - 1)).astype(np.uint16)
            again = times[low:high] > 1
            yield pa.RecordBatch.from_arrays([pa.array([int(found[low] >> 16)], pa.int32()), pa.array([offsets[~again].tobytes()], pa.binary()),
                                              pa.array([offsets[again].tobytes()], pa.binary())], ["page", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held += counters(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells)
            rows += batch.num_rows
            if rows >= FLUSH:
                yield from pages(held)
                held, rows = [], 0
        if rows:
            yield from pages(held)
    return run


def counters(p1: np.ndarray, p2: np.ndarray, cells: int) -> list[np.ndarray]:
    """Numbers of the two counters of each prefix."""
    return [p1 & (cells - 1), cells + (p2 & (cells - 1))]


def merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pages of the sketch (rows sorted by page): one bitmap a page of the counters that reached two."""
    page, count = None, np.zeros(PAGE, np.uint8)

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())],
                                          ["page", "bits"])
    for batch in batches:
        for number, once, again in zip(*(batch.column(c).to_pylist() for c in ("page", "once", "again"))):
            if number != page:
                if page is not None:
                    yield full()
                page, count[:] = number, 0
            met = np.frombuffer(once, np.uint16)
            count[met] = np.minimum(count[met] + 1, 2)
            count[np.frombuffer(again, np.uint16)] = 2
    if page is not None:
        yield full()


def screen(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` with ``maybe`` (its sketch estimate is over one, so it may be shared) and ``parent_maybe``, written. A first turn's
    parent, the root, counts as shared."""
    spark = prefixes.sparkSession
    rows = prefixes.count()
    cells = min(max(1 << (CELLS_PER_PREFIX * rows).bit_length(), LEAST_CELLS), MOST_CELLS)
    pages = prefixes.select("p1", "p2").mapInArrow(sketch_task(cells), "page int, once binary, again binary")
    merged = pages.repartition(parallelism(spark), "page").sortWithinPartitions("page").mapInArrow(merge_task, "page int, bits binary")
    bitmap = np.zeros(max(2 * cells, PAGE) // 8, np.uint8)
    for r in merged.collect():  # at most 2 * MOST_CELLS bits
        bitmap[r.page * PAGE // 8:(r.page + 1) * PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(p1: pd.Series, p2: pd.Series) -> pd.Series:
        bits, out = sent.value, np.ones(len(p1), bool)
        for cell in counters(p1.to_numpy(), p2.to_numpy(), cells):
            out &= (bits[cell >> 3] >> (cell & 7)) & 1 > 0
        return pd.Series(out)

    return materialize(prefixes.withColumns({"maybe": maybe("p1", "p2"), "parent_maybe": (F.col("depth") == 1) | maybe("q1", "q2")}), "screened")


def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive rows of one node (sorted by node and id) as one row: its key, first id and the ids' text."""
    node, ids = None, []

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*node, ids[0])] + [pa.array([",".join(map(str, ids))])],
                                          ["depth", "p1", "p2", "first", "ids"])
    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node or len(ids) == IDS_PER_RUN:
                if ids:
                    yield one()
                node, ids = key, []
            ids.append(conv)
    if ids:
        yield one()


def digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of each node (sorted by node and first id), one state at a time."""
    node, state = None, None

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in node] + [pa.array([state.hexdigest()])], ["depth", "p1", "p2", "digest"])
    for batch in batches:
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node:
                if node is not None:
                    yield one()
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield one()


def end_digests(members: DataFrame) -> DataFrame:
    """(depth, p1, p2, digest): SHA-256 of the comma-joined ids ``conv`` of each node in ascending order. The ids are
    range-partitioned, so the ids of one node are joined up in many tasks; only their text passes through one task, run by run."""
    tasks = parallelism(members.sparkSession)
    key = ["depth", "p1", "p2"]
    runs = members.select(*key, "conv").repartitionByRange(tasks, *key, "conv").sortWithinPartitions(*key, "conv") \
        .mapInArrow(join_ids, "depth long, p1 long, p2 long, first long, ids string")
    return runs.repartition(tasks, *key).sortWithinPartitions(*key, "first") \
        .mapInArrow(digest_ids, "depth long, p1 long, p2 long, digest string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie over ``turns`` (conv, depth from 1, a, b, words) of the conversations ``convs`` (conv,
    length): conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: words a member more than the first need not repeat) and ends_sha256.

    Every conversation, a turnless one too, is a member of the root; without any there is no root and no row."""
    key, up = ["depth", "p1", "p2"], ["up_depth", "q1", "q2"]
    screened = screen(prefix_digests(turns))
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "q1", "q2", "words")],
                        (F.col("length") == 0).alias("last"))
    shared = screened.where("maybe").drop("maybe", "parent_maybe").unionByName(root)
    tails = screened.where("not maybe")
    nodes = materialize(shared.groupBy(*key).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("words").alias("words"),
        F.sum(F.col("last").cast("long")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end")), "shared-nodes")

    above = lambda df: df.withColumn("up_depth", F.col("depth") - 1)
    kids = above(nodes.where("depth > 0")).select(*up).unionAll(above(tails.where("parent_maybe")).select(*up)) \
        .groupBy(*up).agg(F.count(F.lit(1)).alias("n_children")).toDF(*key, "n_children")
    counted = nodes.join(kids, key, "left") \
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "value": (F.col("n") - 1) * F.col("words"), "place": F.col("depth") + 1})
    counted = materialize(counted, "counted-nodes")

    # what each conversation is charged with: the nodes it is the smallest member of, and a leaf that it ends at
    charged = counted.groupBy("conv").agg(F.sum("value").alias("value"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")) \
        .unionByName(tails.where("last").select("conv", F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("leaf"))) \
        .groupBy("conv").agg(F.sum("value").alias("value"), F.max("leaf").alias("leaf"))
    sums = shared.select(*key, "conv").join(charged, "conv").groupBy(*key).agg(F.sum("value").alias("charged"), F.sum("leaf").alias("n_leaves"))
    partial, before = running(counted, "conv", "place", {"upto": "sum(value)"}, "long-charges")
    owed = partial.join(before, ["conv", "stretch"], "left").withColumn(
        "further_up", F.col("upto") - F.col("value") + F.coalesce("upto_before", F.lit(0))).drop("upto", "upto_before", "ends", "more", "stretch")

    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    several = materialize(nodes.where("n_ends > 1").select(*key), "shared-ends")
    ends = materialize(end_digests(shared.where("last").join(several, key, "left_semi")), "end-digests")
    full = above(owed.join(sums, key)).join(parents, up, "left").join(ends, key, "left")
    one_end = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    shared_rows = full.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("charged") - F.col("further_up")).alias("saved_tokens"),
        F.when(F.col("n_ends") == 0, NO_IDS).when(F.col("n_ends") == 1, one_end("end")).otherwise(F.col("digest")).alias("ends_sha256"))
    single = lambda df, parent: df.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), one_end("conv")).otherwise(NO_IDS).alias("ends_sha256"))
    first = single(above(tails.where("parent_maybe")).join(parents, up), F.col("parent"))
    return shared_rows.unionByName(first).unionByName(single(tails.where("not parent_maybe"), F.col("conv")))


def conversation_prefixes(conversations: DataFrame, group: int = GROUP, openings: int = OPENINGS, conv_col: str = "conv_id",
                          turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations (``lend_openings``).

    Null and empty roles and texts are empty turns like any other, turns of no conversation are left out, repeated turns count as
    often as they stand there, those of one turn number go by digest, and texts of any length count whole. Other columns,
    whatever their names, are not read. An empty table gives an empty result."""
    turns, convs = lend_openings(turn_digests(conversations, conv_col, turn_col, role_col, text_col), group, openings)
    return prefix_trie(turns, convs)


def with_last_turn(trie: DataFrame, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """A trie over conversations as they stand (``prefix_trie(turns, convs)`` of ``turn_digests``) with the ``role`` and ``text`` of each
    node's last turn; the root has none."""
    said = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = with_position(said.withColumns({"_a": half(digest, 1), "_b": half(digest, 17)}), "conv_id", ["_turn", "_a", "_b"], "_place")
    return trie.join(placed.select("conv_id", (F.col("_place") + 1).alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
