"""Exact duplicates by Patricia-trie owners.

Texts are equal when their normalised bytes are (all characters of ``common.SPACE`` deleted).
Two passes insert whole byte strings into compressed radix tries whose terminal nodes hold the
owner (the row that stays) and the number of rows seen:

1. on the scan, per task: each distinct text of the task leaves once, so a text that makes up a
   third of all rows crosses the network once per task, not once per row;
2. after a shuffle on (length, content hash), sorted: a trie holds one (length, hash) run.

A trie that outgrows its byte budget spills its heaviest subtree: in pass 1 the subtree's
terminals are sent on early (pass 2 adds them up), in pass 2 they go to a temporary file of the
task, which is replayed through a trie of its own after the run, subtree by subtree.

The decisions are joined back to the narrow rows (id, length, digest), never to texts.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_batch, fresh

TRIE_BYTES = 64 << 20
NODE_BYTES = 400  # Python objects of a node, besides its label

TERMINALS = "length long, hash long, body binary, digest string, points long, owner long, n long"
OWNERS = "digest string, keep_id long, group_size long"
ROWS = "id long, raw long, text_sha256 string"

DELETED = SPACE.encode()


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, children: dict[int, Node], owner: tuple | None) -> None:
        self.label, self.children, self.owner = label, children, owner


def better(a: tuple, b: tuple) -> tuple:
    """Merged owner (points, id, digest, n): most code points, then the smallest id; null ids last."""
    rank = lambda o: (-o[0], o[1] is None, o[1] or 0)
    return (*(a if rank(a) <= rank(b) else b)[:3], a[3] + b[3])


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by bisection over slices."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """Compressed radix trie over bytes; a terminal node holds the owner of its string."""

    def __init__(self) -> None:
        self.root, self.bytes = Node(b"", {}, None), 0

    def insert(self, key: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], {}, owner)
                self.bytes += len(key) - at + NODE_BYTES
                return
            if not key.startswith(child.label, at):
                cut = shared_prefix(child.label, key, at)
                upper = Node(child.label[:cut], {child.label[cut]: child}, None)
                child.label = child.label[cut:]
                node.children[key[at]] = child = upper
                self.bytes += NODE_BYTES
            node, at = child, at + len(child.label)
        node.owner = owner if node.owner is None else better(node.owner, owner)

    @staticmethod
    def terminals(node: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, prefix)]
        while stack:
            top, before = stack.pop()
            whole = before + top.label
            if top.owner is not None:
                yield whole, top.owner
            stack.extend((c, whole) for c in top.children.values())

    def cut_heaviest(self) -> tuple[bytes, Node] | None:
        """Takes the heaviest subtree below the first fork out: (path above it, its node).
        None if the trie holds one string only: there is nothing to split."""
        node, path = self.root, b""
        while len(node.children) == 1 and node.owner is None:
            (node,) = node.children.values()
            path += node.label
        if not node.children:
            return None
        first, child = max(node.children.items(), key=lambda kv: weight(kv[1]))
        del node.children[first]
        self.bytes -= weight(child)
        return path, child


def weight(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        top = stack.pop()
        total += len(top.label) + NODE_BYTES
        stack.extend(top.children.values())
    return total


def resolve(rows: Iterator[tuple[bytes, tuple]], budget: int) -> Iterator[tuple[bytes, tuple]]:
    """One (text, owner) per distinct text of ``rows``; subtrees beyond ``budget`` wait in files.
    The strings of a file share a prefix that gets longer with each level, down to one string."""
    trie, spilled = Patricia(), {}
    for key, owner in rows:
        file = next((f for p, f in spilled.items() if key.startswith(p)), None)
        if file is not None:
            pickle.dump((key, owner), file)
            continue
        trie.insert(key, owner)
        while trie.bytes > budget and (cut := trie.cut_heaviest()):
            above, node = cut
            spilled[above + node.label[:1]] = file = tempfile.TemporaryFile()
            for entry in trie.terminals(node, above):
                pickle.dump(entry, file)
    yield from trie.terminals(trie.root)
    del trie
    for file in spilled.values():
        yield from resolve(replay(file), budget)
        file.close()


def replay(file) -> Iterator[tuple[bytes, tuple]]:
    size = file.tell()
    file.seek(0)
    while file.tell() < size:
        yield pickle.load(file)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 1000) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; ``step`` rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


TERMINAL_ARROW = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("digest", pa.string()),
                            ("points", pa.int64()), ("owner", pa.int64()), ("n", pa.int64())])
OWNER_ARROW = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def scan_terminals(budget: int):
    """Pass 1: distinct texts of the task with their owners so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(entries) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for body, (points, owner, (hashed, digest), n) in entries:
                rows.append((len(body), hashed, body, digest, points, owner, n))
                size += len(body)
                if size > 8 << 20:
                    yield batch_of(rows, TERMINAL_ARROW)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows, TERMINAL_ARROW)

        trie = Patricia()
        for ident, text, points in rows_of(batches):
            body = text.translate(None, DELETED)
            hashed = xxhash.xxh64_intdigest(body) - (1 << 63)
            trie.insert(body, (points, ident, (hashed, hashlib.sha256(body).hexdigest()), 1))
            while trie.bytes > budget:
                above, node = trie.cut_heaviest() or (b"", trie.root)
                yield from send(trie.terminals(node, above))
                if node is trie.root:
                    trie = Patricia()
        yield from send(trie.terminals(trie.root))
    return run


def run_owners(budget: int):
    """Pass 2: rows come sorted by (length, hash); each run goes through a trie of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple]:
            for _, group in groupby(rows_of(batches), key=lambda r: r[:2]):
                for _, (_, owner, digest, n) in resolve(((r[2], (r[4], r[5], r[3], r[6])) for r in group), budget):
                    yield digest, owner, n

        out = []
        for row in runs():
            out.append(row)
            if len(out) == 20_000:
                yield batch_of(out, OWNER_ARROW)
                out = []
        if out:
            yield batch_of(out, OWNER_ARROW)
    return run


def digest_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    digests = [hashlib.sha256(text.translate(None, DELETED)).hexdigest()
               for at in range(0, batch.num_rows, 1000) for text in batch.column(2).slice(at, 1000).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests)], ["id", "raw", "text_sha256"])


def decisions(docs: DataFrame, id_col: str, text_col: str, trie_bytes: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    owners = base.select("id", F.col("text").cast("binary"), F.char_length("text").cast("long").alias("points")) \
        .mapInArrow(scan_terminals(trie_bytes), TERMINALS) \
        .repartition("length", "hash").sortWithinPartitions("length", "hash") \
        .mapInArrow(run_owners(trie_bytes), OWNERS)
    rows = base.select("id", F.xxhash64("text").alias("raw"), F.col("text").cast("binary")).mapInArrow(by_batch(digest_batch), ROWS)
    return rows.join(owners, F.col("text_sha256") == F.col("digest")).drop("digest") \
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id`` (row that stays: most code points in the original text,
    then the smallest id), ``group_size``, ``kept``, ``text_sha256`` (of the normalised text).

    Null texts count as empty texts and form one group with them and with texts of white space
    only. A row without id stays only if its group has none with an id and equal length. Rows
    repeated with their id are one document listed several times: they count in ``group_size``
    and get the same decision. An empty table gives an empty result. Other columns are ignored."""
    return decisions(docs, id_col, text_col, trie_bytes).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops; columns unchanged."""
    key, raw = fresh(docs, "_keep"), fresh(docs, "_raw")
    keep = decisions(docs, id_col, text_col, trie_bytes).where("kept") \
        .select(F.col("id").alias(key), F.col("raw").alias(raw)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & \
        (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(raw))
    return docs.join(keep, same, "left_semi")
