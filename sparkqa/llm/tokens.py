"""Byte-level BPE ids of whole texts, with a bounded memo of the pieces between spaces."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import tiktoken

MEMO_PIECES = 500_000


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    The split pattern never matches across a single space between two other characters (the
    space opens the next match), so the text may be cut before each such space and the ids of the
    parts joined; parts are remembered, ``memo_pieces`` of them at most."""

    def __init__(self, ranks_path: str, pattern: str, memo_pieces: int = MEMO_PIECES) -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo, self.limit = {}, memo_pieces

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        pieces = [parts[0], *[" " + p for p in parts[1:]]]
        memo = self.memo
        ids = [memo.get(p) for p in pieces]
        if None in ids:
            for i, known in enumerate(ids):
                if known is None:
                    piece = pieces[i]
                    # an empty or white end means that a cut beside this piece may not be safe
                    if len(piece) == (i > 0) or piece[-1].isspace() or i and piece[1].isspace():
                        return b"".join(map(self.piece, rejoined(pieces)))
                    ids[i] = self.piece(piece, memo)
        return b"".join(ids)

    def piece(self, piece: str, memo: dict | None = None) -> bytes:
        """Ids of one piece; remembered in ``memo``, which holds pieces with safe ends only."""
        known = self.memo.get(piece)
        if known is None:
            known = array("I", self.plain(piece)).tobytes()
            if memo is not None and len(piece) <= 64:
                if len(memo) >= self.limit:
                    memo.clear()
                memo[piece] = known
        return known


def rejoined(pieces: list[str]) -> list[str]:
    """Joins each piece to the one before unless both ends at the cut are free of white space."""
    out = [pieces[0]]
    for piece in pieces[1:]:
        if len(piece) == 1 or piece[1].isspace() or not out[-1] or out[-1][-1].isspace():
            out[-1] += piece
        else:
            out.append(piece)
    return out


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(ranks_path, pattern)
