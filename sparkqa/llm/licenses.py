"""License scan by conditional compression, confirmed by exact wording.

1. Candidate blocks. A block may differ from a template of m words by ``m // WORDS_PER_DIFFERENCE`` words at
   most. Cut into one piece more than that, at least one piece of the template is in the block unchanged, so
   the anchors (three words out of each piece, two or less in shorter ones) miss no block. A block is
   the stretch of the document that the template would cover around an anchor, with room for the differences.
2. Ranking. Each block is compressed by itself and with each template as a raw zstandard
   dictionary; templates rank by how much smaller the block gets.
3. Confirmation. In that order, the first template whose wording is in the block with few enough
   differences (words left out, put in or replaced; block words around the template don't count) wins.

Words are runs of ASCII letters and digits in lower case, so punctuation, line breaks and case don't matter; a dotted
number is one word, and ``2.0`` and ``v2`` read as ``2``. Words that tell one license from another (version numbers,
Affero, Lesser, ShareAlike, ...) are no noise: they are never left out, put in or replaced.

Notices ("licensed under the X, version n", ``notice``) are found by their names: every word that isn't ``GENERIC`` has
to be there, names in one piece, and about half as many generic words as the template has words may differ. A block
of a notice is ranked against every notice that shares a name with it. Names without "license" or a version ("released
under MIT") need a verb of licensing before and nothing after that they could belong to, names of a family ("the Apache
License") the verb, and no version after. Further names of a list
("under the Apache License 2.0, the MIT License or ...") are read as if "under" stood before them. A notice that its
sentence denies ("not released under ...") has the denial among its differences, as ``!not``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import TEMPLATES

WORDS_PER_DIFFERENCE = 10
WORD = re.compile(r"[A-Za-z0-9]+(?:(?<=[0-9])\.[0-9]+)*")
#: Words that change which license is meant, alone or after the word given.
VARIANTS = frozenset("attribution affero lesser noncommercial nc noderivatives noderivs nd sharealike sa".split())
VARIANTS_AFTER = frozenset({("gnu", "library"), ("non", "commercial"), ("no", "derivatives"), ("no", "derivative"), ("no", "derivs"),
                            ("share", "alike")})
#: A version: a number of one or two digits, a dotted number, or one that ends a name (``gplv3``, ``gpl3``).
VERSION = re.compile(r"\d{1,2}(?:\.\d+)*|(?:cc|[al]?gplv?)\d[\d.]*")
#: In templates with more words, numbers other than those after "version" may be of sections, lists or years.
NOTICE_WORDS = 40
OVER = 1 << 20
#: Notices have so many words at most; around their names these may be left out, put in or replaced.
SHORT_WORDS = 15
GENERIC = frozenset("""a all an and any are as available be by code conditions content copyright data distributed documentation file
    files following generic has have in international is it its library licence licenced license licensed made material may of
    either offered package program project provided published redistributed released repository shared software source terms text that
    the these this to unported used v version was were which work works""".split()) - {"by"}
#: What joins the licenses of a list, and what a notice without "license" and version needs before it.
JOINING = frozenset("or and either both".split())
LIST_MARKS = re.compile(r"[,/&+|]")
VERBS = frozenset("available distributed licenced licensed offered provided published redistributed released shared".split())
DENIALS = frozenset("cannot neither never no none nor not isn aren wasn weren".split())
#: A denial counts so many words before a notice, in the same sentence.
DENIAL_WORDS = 8
SENTENCE_END = re.compile(r"[.!?;:\n](?:\s|$)")
LEVEL = 3
MEMO_WORDS = 1_000_000

FINDING = pa.schema([("id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                     ("reduction", pa.float64()), ("n_differences", pa.int32()), ("differences", pa.string())])


def normal(word: str) -> str:
    """Lower case; versions without a leading ``v`` and closing zeros; ``gpl3`` is ``gplv3``."""
    word = word.lower()
    if word[-1].isdigit():
        word = re.sub(r"^v(?=\d)", "", word)
        word = re.sub(r"^([al]?gpl)(?=\d)", r"\1v", word)
        while word.endswith(".0"):
            word = word[:-2]
    return word


def fixed_words(words: list[str], notice: bool) -> np.ndarray:
    """Which of the (normal) words tell licenses apart."""
    before = ["", *words]
    return np.fromiter((w in VARIANTS or (b, w) in VARIANTS_AFTER
                        or (notice or b in ("version", "versions", "v")) and VERSION.fullmatch(w) is not None
                        for b, w in zip(before, words)), bool, len(words))


def name_words(words: list[str]) -> np.ndarray | None:
    """Which (normal) words of a notice are its names, or None if ``words`` are no notice: a short text
    with "under" and a name. "License" is part of a name without version."""
    if len(words) > SHORT_WORDS or "under" not in words:
        return None
    version = any(VERSION.fullmatch(w) for w in words)
    names = np.array([w not in GENERIC or w in ("license", "licence") and not version for w in words])
    names |= fixed_words(words, True)
    return names if sum(names) > words.count("under") else None


def align(block: list[str], wanted: list[str], limit: int) -> tuple[int, int, list[str]] | None:
    """(first, end, differences) of the stretch of ``block`` nearest to ``wanted``, or None if over ``limit``
    differences: edit distance over words, free at both ends of the block, in which words that tell licenses
    apart (in notices: all but generic words) have no part. Among equals the stretch that ends last, read with
    as many words in place as can be."""
    block, wanted = list(map(normal, block)), list(map(normal, wanted))
    notice, known, names = len(wanted) <= NOTICE_WORDS, {}, name_words(wanted)
    codes, wanted_codes = (np.array([known.setdefault(w, len(known)) for w in ws], np.int32) for ws in (block, wanted))
    if names is None:
        put_in, left_out = (np.where(fixed_words(ws, notice), OVER, 1) for ws in (block, wanted))
    else:
        put_in = np.where(fixed_words(block, True) | np.array([w not in GENERIC for w in block], bool), OVER, 1)
        left_out = np.where(names, OVER, 1)
    paid = np.concatenate([[0], np.cumsum(put_in)])
    cost = np.zeros((len(wanted) + 1, len(block) + 1), np.int16)
    over = limit + 1  # larger costs need not be told apart
    row = np.zeros(len(block) + 1, np.int64)
    for i, w in enumerate(wanted_codes):
        here = row + left_out[i]
        np.minimum(here[1:], row[:-1] + np.where(codes == w, 0, np.maximum(put_in, left_out[i])), out=here[1:])
        if names is None or not whole_names(wanted, names, i):
            here = np.minimum.accumulate(here - paid) + paid
        row = np.minimum(here, over)
        cost[i + 1] = row
    end = len(block) - int(cost[-1][::-1].argmin())
    if cost[-1][end] > limit:
        return None
    i, j, notes = len(wanted), end, []
    while i:
        here = cost[i][j]
        if j and here == cost[i - 1][j - 1] + (0 if block[j - 1] == wanted[i - 1] else max(put_in[j - 1], left_out[i - 1])):
            i, j = i - 1, j - 1
            if block[j] != wanted[i]:
                notes.append(f"{wanted[i]}>{block[j]}")
        elif here == cost[i - 1][j] + left_out[i - 1]:
            i -= 1
            notes.append(f"-{wanted[i]}")
        else:
            j -= 1
            notes.append(f"+{block[j]}")
    return j, end, notes[::-1]


def whole_names(wanted: list[str], names: np.ndarray, i: int) -> bool:
    """Whether nothing may stand between word ``i`` of a notice and the next one: both are of one name."""
    return i + 1 < len(wanted) and names[i] and names[i + 1] and wanted[i] != "under"


class Scanner:
    """Templates with their anchors and compressors."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = {n: [w.lower() for w in WORD.findall(templates[n])] for n in self.names}
        if not all(self.words.values()):
            raise ValueError("a template needs at least one word")
        self.normal = {n: list(map(normal, self.words[n])) for n in self.names}
        self.counts = {n: Counter(self.normal[n]) for n in self.names}
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.raw = {n: zstandard.ZstdCompressionDict(" ".join(self.words[n]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    for n in self.names}
        self.anchors: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        self.notices = set()
        for n in self.names:
            words, pieces, names = self.normal[n], self.limit(n) + 1, name_words(self.normal[n])
            if names is None:
                cuts = [len(words) * k // pieces for k in range(pieces + 1)]
            else:  # the names are there whatever differs, so one anchor will do
                self.notices.add(n)
                cuts = max(name_runs(words, names), key=lambda r: (letters(words[r[0]:r[1]]), -r[0]))
            for low, high in zip(cuts, cuts[1:]):
                size = min(3, high - low)
                at = max(range(low, high - size + 1), key=lambda i: (letters(words[i:i + size]), -i))
                self.anchors.setdefault(tuple(words[at:at + size]), []).append((n, at))
        self.limits = {n: self.limit(n) for n in self.names}
        self.needed = {n: {w for w, k in zip(self.normal[n], name_words(self.normal[n])) if k} if n in self.notices else () for n in self.names}
        self.places = {n: (at, len(a)) for a, found in self.anchors.items() for n, at in found if n in self.notices}
        self.sizes = sorted({len(a) for a in self.anchors})
        # a document without a word of each anchor has no anchor
        self.hints = {max(a, key=lambda w: (w.isalpha(), len(w))) for a in self.anchors}
        self.unversioned = {n for n in self.notices if not any(VERSION.fullmatch(w) for w in self.normal[n])}
        self.bare = {n for n in self.unversioned if not any("licen" in w and w[-1] != "d" for w in self.normal[n])}
        generic = {n: frozenset(self.needed[n] - {"license", "licence"}) for n in self.notices}
        versioned = {frozenset(w for w in generic[n] if not VERSION.fullmatch(w)) for n in self.notices - self.unversioned}
        #: a family whose versions are templates too, or names that may mean something else
        self.loose = self.bare | {n for n in self.unversioned if generic[n] in versioned}
        self.named: dict[str, set[str]] = {}
        for n in self.notices:
            for w in self.needed[n] - {"under", "license", "licence"}:
                if not VERSION.fullmatch(w) or w[0].isalpha():
                    self.named.setdefault(w, set()).add(n)
        self.memo: dict[tuple, tuple[tuple, ...]] = {}
        self.memo_words = 0

    def limit(self, name: str) -> int:
        m = len(self.words[name])
        return m // WORDS_PER_DIFFERENCE if name_words(list(map(normal, self.words[name]))) is None else (m + 3) // 2

    def blocks(self, words: list[str]) -> set[tuple[int, int, tuple[str, ...], tuple[int, int]]]:
        """Stretches (first, end, templates, (first, end) of the words that a finding has to hold) of ``words`` that may
        hold one of the templates: all notices that share a name with the stretch, or any that may be confirmed and is
        no notice; of one template, those that overlap by more than the room for differences are one stretch. A notice
        holds its anchor once, so its stretch ends at the anchors beside it, and its finding has to hold that anchor."""
        starts: dict[str, set[int]] = {}
        for size in self.sizes:
            for i, gram in enumerate(zip(*(words[k:] for k in range(size)))):
                for name, at in self.anchors.get(gram, ()):
                    starts.setdefault(name, set()).add(i - at)
        out = set()
        for name, found in starts.items():
            room, m = self.limits[name], len(self.words[name])
            if m - room > len(words):
                continue
            if name in self.notices:
                at, size = self.places[name]
                hits = [-size, *(s + at for s in sorted(found)), len(words)]
                for before, hit, after in zip(hits, hits[1:], hits[2:]):
                    low, high = max(hit - at - room, before + 1, 0), min(hit - at + m + room, after + size - 1, len(words))
                    counts = Counter(words[low:high])
                    if self.possible(name, counts):
                        out.add((low, high, tuple(sorted(set().union(*(self.named.get(w, ()) for w in counts)))), (hit, hit + size)))
                continue
            for first, last in grouped(sorted(found), room):
                low, high = max(first - room, 0), min(last + m + room, len(words))
                counts = Counter(words[low:high])
                if self.possible(name, counts):
                    names = tuple(n for n in self.names if n not in self.notices and self.possible(n, counts))
                    out.add((low, high, names, (high, low)))  # no word in particular
        return out

    def possible(self, name: str, counts: Counter) -> bool:
        """Whether enough words of the template are among ``counts`` for it to be confirmed."""
        missing = 0
        for w, n in self.counts[name].items():
            if n > (here := counts[w]):
                missing += n - here
                if missing > self.limits[name] or w in self.needed[name]:
                    return False
        return True

    def rank(self, block: list[str], names: tuple[str, ...]) -> list[tuple[float, str]]:
        """(size reduction, template), largest first."""
        raw = " ".join(block).encode()
        alone = len(self.plain.compress(raw))
        sizes = {n: len(zstandard.ZstdCompressor(level=LEVEL, dict_data=self.raw[n]).compress(raw)) for n in names}
        return sorted(((1 - sizes[n] / alone, n) for n in names), key=lambda r: (-r[0], r[1]))

    def confirmed(self, block: list[str], names: tuple[str, ...]) -> tuple[tuple, ...]:
        """(template, first, end, reduction, differences) of the templates that are confirmed, best ranked first."""
        key = (names, *block)
        if key not in self.memo:
            self.memo_words += len(key)
            if self.memo_words > MEMO_WORDS:
                self.memo.clear()
                self.memo_words = len(key)
            counts, found = Counter(block), []
            for reduction, name in self.rank(block, names):
                if self.possible(name, counts) and (at := align(block, self.words[name], self.limits[name])):
                    found.append((name, at[0], at[1], reduction, at[2]))
            self.memo[key] = tuple(found)
        return self.memo[key]

    def winner(self, doc: Words, first: int, end: int, names: tuple[str, ...], held: tuple[int, int], listed: bool = False) -> tuple | None:
        """(first, end, template, reduction, differences) of the best ranked template that is confirmed in the words from
        ``first`` to ``end``, holds the words ``held`` and may stand there; ``listed``: as if "under" stood before them,
        where it has to begin."""
        block = doc.words[first:end]
        for name, low, high, reduction, notes in self.confirmed(["under", *block] if listed else block, names):
            if listed:
                if low or high < 2:
                    continue
                high -= 1
            low, high = first + low, first + high
            if low > held[0] or high < held[1] or name in self.unversioned and doc.version_at(high):
                continue
            if name in self.loose and not listed and VERBS.isdisjoint(doc.words[max(low - 2, 0):high]):
                continue
            if name in self.bare and not doc.ends(high):
                continue
            return low, high, name, reduction, tuple(notes)
        return None

    def listed(self, doc: Words, end: int) -> Iterator[tuple]:
        """Further notices of the list that goes on at word ``end``, if one does."""
        while end < len(doc.words):
            first = end
            while first < len(doc.words) and doc.words[first] in JOINING:
                first += 1
            if first == end and not LIST_MARKS.fullmatch(doc.between(end).strip()):
                return
            window = doc.words[first:first + SHORT_WORDS]
            found = {best for low, high, names, held in self.blocks(["under", *window]) if not low and set(names) <= self.notices
                     if (best := self.winner(doc, first, first + high - 1, names, (first + held[0] - 1, first + held[1] - 1), listed=True))}
            if not found:
                return
            best = min(found, key=lambda f: (f[0] - f[1], -f[3], f[2]))
            yield best
            end = best[1]

    def scan(self, text: str) -> list[tuple]:
        """Findings (template, start, end, reduction, differences) of a text in order, by character; of
        overlapping ones the one with more words stays, then the larger reduction."""
        if self.hints.isdisjoint(map(normal, WORD.findall(text))):
            return []
        doc = Words(text)
        won = {best for block in self.blocks(doc.words) if (best := self.winner(doc, *block))}
        kept: list[tuple] = []
        for f in sorted(won, key=lambda f: (f[0] - f[1], -f[3], f[0], f[2])):
            if all(f[1] <= k[0] or k[1] <= f[0] for k in kept):
                kept.append(f)
        out = []
        for f in sorted(kept):
            denied = doc.denial(f[0]) if f[2] in self.notices else ()
            group = [f]
            if f[2] in self.notices:
                for more in self.listed(doc, f[1]):
                    if any(more[0] < k[1] and k[0] < more[1] for k in kept):
                        break
                    group.append(more)
            out.extend((low, high, name, reduction, (*denied, *notes)) for low, high, name, reduction, notes in group)
        return [(name, doc.spans[low][0], doc.spans[high - 1][1], reduction, list(notes)) for low, high, name, reduction, notes in sorted(out)]


class Words:
    """The (normal) words of a text and what stands between them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in WORD.finditer(text)]
        self.words = [normal(text[a:b]) for a, b in self.spans]

    def between(self, i: int) -> str:
        """What stands before word ``i``, after the word before it."""
        return self.text[self.spans[i - 1][1]:self.spans[i][0]] if 0 < i < len(self.spans) else ""

    def version_at(self, i: int) -> bool:
        """Whether a version begins at word ``i``, in the same sentence."""
        for at in (i, i + 1):
            if at >= len(self.words) or SENTENCE_END.search(self.between(at)):
                return False
            if VERSION.fullmatch(self.words[at]):
                return True
            if self.words[at] not in ("version", "v"):
                return False
        return False

    def ends(self, i: int) -> bool:
        """Whether names that stop before word ``i`` stop there: the text, a line, a list member or "license" follows."""
        return (i >= len(self.words) or re.search(r"[^\w\s-]|\n", self.between(i)) is not None or self.words[i] in JOINING
                or self.words[i] in ("license", "licenses", "licence", "licences"))

    def denial(self, i: int) -> tuple[str, ...]:
        """The nearest denial before word ``i`` in its sentence, as a difference."""
        for at in range(i, max(i - DENIAL_WORDS, 0), -1):
            if SENTENCE_END.search(self.between(at)):
                break
            if self.words[at - 1] in DENIALS:
                return (f"!{self.words[at - 1]}",)
        return ()


def letters(words: list[str]) -> int:
    return sum(map(len, words))


def name_runs(words: list[str], names: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the names of a notice, "under" apart."""
    first = None
    for i, w in enumerate([*words, "under"]):
        inside = i < len(words) and names[i] and w != "under"
        if inside and first is None:
            first = i
        elif not inside and first is not None:
            yield first, i
            first = None


def grouped(starts: list[int], room: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of sorted ``starts`` whose first and last lie at most 2 x ``room`` apart: what
    differences can move the anchors of one occurrence."""
    first = last = None
    for s in starts:
        if first is not None and s - first <= 2 * room:
            last = s
            continue
        if first is not None:
            yield first, last
        first = last = s
    if first is not None:
        yield first, last


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...] | None) -> Scanner:
    """One scanner per Python worker and set of templates (None: those of the package)."""
    return Scanner(TEMPLATES if templates is None else dict(templates))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per license text found in a row of ``docs``: id, ``license``, ``start`` and ``end`` (code points of the
    whole text), ``reduction`` (share of the compressed size that the template saves), ``n_differences`` and
    ``differences`` (``-word`` left out, ``+word`` put in, ``a>b`` replaced, ``!word`` denied by its sentence).

    Null and empty texts have none. Very long texts are scanned whole, block by block, in one task. Other columns are not
    read, whatever their names, and don't come back. Rows without id and repeated rows are scanned like any other;
    an empty table gives an empty result. Texts are scanned where they are read: nothing is shuffled."""
    known = None if templates is None else tuple(sorted(templates.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(known).scan
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.extend((ident, name, start, end, reduction, len(notes), " ".join(notes))
                                for name, start, end, reduction, notes in scan(text or ""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FINDING)], schema=FINDING)

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, license string, start long, end long, reduction double, n_differences int, differences string")
    return found.withColumnRenamed("id", id_col)
