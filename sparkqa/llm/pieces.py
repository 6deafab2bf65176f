"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces reads a text once; at each position its output links give every piece
that ends there, and each relaxes the best segmentation of the text so far:

* ``unigram`` models: the highest sum of scores wins (a character without a piece of its own counts as
  unknown, at the lowest score less 10).
* ``bpe`` models: scores order the merges, sums of them mean nothing. The segmentation of a prefix
  ends in the one piece that merging would leave beside the last piece before it, so a piece relaxes
  a position only if merging the two leaves them apart. Ids are those of the public library.

Whether merging leaves two pieces apart is read off their merge trees: the last characters of the left one and
the first ones of the right one grow step by step, and a piece across the border would have to come before the next step on
either side.

Unknown characters become byte pieces. No piece reaches over the start of a run of spaces, so texts
are cut there; the ids of the units are remembered in two generations of bounded size, of which the older is dropped.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch

SPACE_MARK = "▁"
MEMO_UNITS = 400_000  # units of each of two generations, and pairs of pieces, that a worker remembers
UNKNOWN_PENALTY = 10.0
PAIR = 1 << 32  # more than any piece id: a pair of pieces is one number
KINDS = ("unigram", "bpe")


class Pieces:
    """Pieces with scores, and the two directions between text and ids."""

    def __init__(self, pieces: list[str | None], scores: list[float], byte_ids: list[int], kind: str, unknown_id: int = 0,
                 dummy_prefix: bool = True) -> None:
        """``pieces``: text by id, None for control, unknown and byte pieces; ``byte_ids``: id of each byte, or none."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        self.pieces, self.scores, self.byte_ids, self.kind = pieces, scores, byte_ids, kind
        self.unknown_id, self.prefix = unknown_id, SPACE_MARK if dummy_prefix else ""
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        if self.ids:
            self.automaton.make_automaton()
        self.lowest = min((scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        # what an id decodes to: whole characters, or one byte of some
        self.raw = [(p or "").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        if unknown_id < len(pieces) and pieces[unknown_id] is None:
            self.raw[unknown_id] = " ⁇ ".encode()
        # a mark after other characters inside a piece would forbid cutting texts before it
        inner = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids)
        self.units = re.compile("(?s).+" if inner else f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")
        self.lengths = [len(p or "") for p in pieces]
        order = sorted(self.ids.values(), key=lambda i: (-scores[i], i))
        self.turns: dict[str, int] = {}  # when a piece is merged: equal scores at the same time
        for n, i in enumerate(order):
            self.turns[pieces[i]] = self.turns[pieces[order[n - 1]]] if n and scores[order[n - 1]] == scores[i] else n
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.grown: dict[str, tuple | None] = {}

    @classmethod
    def load(cls, path: str, kind: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([model.id_to_piece(i) if plain(i) else None for i in range(n)], [model.get_score(i) for i in range(n)],
                   byte_ids if model.is_byte(byte_ids[0]) else [], kind, model.unk_id())

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def encode_bytes(self, text: str) -> bytes:
        """Ids as 32-bit integers of the machine."""
        if not text:
            return b""
        memo = self.memo
        units = self.units.findall((self.prefix + text).replace(" ", SPACE_MARK))
        found = [memo.get(u) for u in units]
        if None in found:
            for n, known in enumerate(found):
                if known is None:
                    found[n] = self.unit(units[n])
        return b"".join(found)

    def unit(self, unit: str) -> bytes:
        known = self.memo.get(unit) or self.older.get(unit)
        if known is None:
            known = array("i", self.merged_ids(unit) if self.kind == "bpe" else self.to_ids(self.segment(unit))).tobytes()
        if len(unit) <= 64:
            if len(self.memo) >= MEMO_UNITS:
                self.older, self.memo = self.memo, {}
            self.memo[unit] = known
        return known

    def merged_ids(self, unit: str) -> list[int]:
        """Ids of the pieces that merging leaves of ``unit``, from its end along the last pieces of its prefixes."""
        last, out, e = self.last_merged(unit), [], len(unit)
        while e:
            code = last[e]
            if code <= 0:
                if not self.byte_ids:
                    return self.to_ids(self.segment(unit))
                e -= 1
                out.extend(self.byte_ids[b] for b in reversed(unit[e].encode()))
            else:
                out.append(code - 1)
                e -= self.lengths[code - 1]
        out.reverse()
        return out

    def to_ids(self, segments: list[str]) -> list[int]:
        """Ids of segments; characters without a piece become bytes, or the unknown id without byte pieces
        (a run of them once)."""
        out: list[int] = []
        for s in segments:
            found = self.ids.get(s)
            if found is not None:
                out.append(found)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in s.encode())
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
        return out

    def segment(self, unit: str) -> list[str]:
        """Best segmentation of ``unit``: one pass of the automaton, then back along the last pieces."""
        last = (self.by_score if self.kind == "unigram" else self.by_merges)(unit)
        out, e = [], len(unit)
        while e:
            out.append(last[e] or unit[e - 1])
            e -= len(out[-1])
        return out[::-1]

    def matches(self, unit: str):
        return self.automaton.iter(unit) if self.ids else ()

    def by_score(self, unit: str) -> list[str]:
        """Last piece of the best segmentation of each prefix; '' where that is an unknown character."""
        n = len(unit)
        best, last, settled = [0.0] + [-np.inf] * n, [""] * (n + 1), 0
        single = [False] * (n + 1)

        def settle(upto: int) -> None:
            nonlocal settled
            while settled < upto:
                settled += 1
                if not single[settled] and best[settled - 1] + self.lowest > best[settled]:
                    best[settled], last[settled] = best[settled - 1] + self.lowest, ""

        for end, (piece, length) in self.matches(unit):
            e = end + 1
            settle(end)
            single[e] |= length == 1
            score = best[e - length] + self.scores[piece]
            if score > best[e]:
                best[e], last[e] = score, unit[e - length:e]
        settle(n)
        return last

    def by_merges(self, unit: str) -> list[str]:
        """Last piece that merging leaves of each prefix; '' where that is an unknown character."""
        return [self.pieces[code - 1] if code > 0 else "" for code in self.last_merged(unit)]

    def last_merged(self, unit: str) -> list[int]:
        """Id + 1 of the last piece that merging leaves of each prefix; not over 0 where that is an unknown character."""
        last, apart = [0] * (len(unit) + 1), self.apart  # -code point of an unknown character
        for end, (piece, length) in self.matches(unit):
            e = end + 1
            if last[e]:
                continue
            s = e - length
            left = last[s]
            if not left and s:
                left = last[s] = -ord(unit[s - 1])  # no piece ended there
            known = apart.get(left * PAIR + piece)
            if known is None:
                known = self.stays(left, piece)
            if known:
                last[e] = piece + 1
        return last

    def stays(self, left: int, piece: int) -> bool:
        """True if merging the characters of both leaves exactly these two (``left`` 0: nothing before)."""
        if len(self.apart) >= MEMO_UNITS:
            self.apart.clear()
        before, text = None if not left else self.pieces[left - 1] if left > 0 else chr(-left), self.pieces[piece]
        growth = self.growth(text), self.growth(before) if before else ((), ())
        if None in growth:
            parts = [before, text] if before else [text]
            known = self.merged("".join(parts)) == parts
        else:
            known = bool(growth[0][0]) and not any(
                (turn := self.turns.get(a + b)) is not None and turn < next_a and turn <= next_b
                for a, next_a in growth[1][1] for b, next_b in growth[0][0])
        self.apart[left * PAIR + piece] = known
        return known

    def growth(self, text: str) -> tuple | None:
        """How the first and the last characters of a piece grow by merging: (first parts, last parts), each (text, turn of its next merge).
        Two empty lists: merging never leaves this piece whole. None: merges don't come in the order of
        their turns, so nothing can be read off."""
        if text in self.grown:
            return self.grown[text]
        parts, turns = [(c, -1, None, None) for c in text], self.turns  # text, turn, left part, right part
        in_order = True
        while len(parts) > 1:
            found = [(turn, n) for n in range(len(parts) - 1) if (turn := turns.get(parts[n][0] + parts[n + 1][0])) is not None]
            if not found:
                break
            turn, n = min(found)
            in_order &= turn > parts[n][1] and turn > parts[n + 1][1]
            parts[n:n + 2] = [(parts[n][0] + parts[n + 1][0], turn, parts[n], parts[n + 1])]
        sides: list[list[tuple[str, float]]] = [[], []]
        if len(parts) == 1:
            for side, child in ((0, 2), (1, 3)):
                node, later = parts[0], float("inf")
                while node:
                    sides[side].append((node[0], later))
                    later, node = node[1], node[child]
        self.grown[text] = (sides[0], sides[1]) if in_order else None
        return self.grown[text]

    def merged(self, text: str) -> list[str]:
        """Merges of a short text, best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.scores[i], n) for n in range(len(parts) - 1) if (i := self.ids.get(parts[n] + parts[n + 1])) is not None]
            if not scored:
                break
            n = min(scored)[1]
            parts[n:n + 2] = [parts[n] + parts[n + 1]]
        return parts

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces join to characters (invalid ones become U+FFFD), space marks become spaces,
        the dummy prefix goes, control ids say nothing, the unknown id is U+2047 between spaces."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace").replace(SPACE_MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(path: str, kind: str) -> Pieces:
    """One table per Python worker and model file."""
    return Pieces.load(path, kind)


def encode(docs: DataFrame, path: str, kind: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
           verify: bool = False) -> DataFrame:
    """(id, text, ids array<int>) of every row; a null text has null ids, an empty one none. Rows without id and
    repeated rows are encoded like any other; an empty table gives an empty result. ``keep_text=False`` leaves the text
    out; ``verify`` adds ``round_trip``: the ids decode to the text (null text: true)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, found, null, same = pieces(path, kind), [], [], []
        for at in range(0, batch.num_rows, 500):
            for text in batch.column(1).slice(at, 500).to_pylist():
                ids = table.encode_bytes(text or "")
                found.append(ids)
                null.append(text is None)
                if verify:
                    same.append(table.decode(array("i", ids).tolist()) == (text or ""))
        offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)), mask=pa.array(null))
        columns = {"id": batch.column(0), "text": batch.column(1), "ids": ids, "round_trip": pa.array(same, pa.bool_())}
        names = ["id", *["text"] * keep_text, "ids", *["round_trip"] * verify]
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    schema = "id long, " + "text string, " * keep_text + "ids array<int>" + ", round_trip boolean" * verify
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(run), schema)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def decode(encoded: DataFrame, path: str, kind: str) -> DataFrame:
    """``encoded`` (any columns, ``ids`` among them) with ``decoded``; null ids give null."""
    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != "decoded"], T.StructField("decoded", T.StringType())])
    names = [n for n in encoded.columns if n != "decoded"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = pieces(path, kind)
        texts = pa.array([None if i is None else table.decode(i) for at in range(0, batch.num_rows, 500)
                          for i in batch.column("ids").slice(at, 500).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], texts], [*names, "decoded"])
    return encoded.select(*names).mapInArrow(by_batch(run), schema)
