"""Text column expressions (all JVM-side, no Python per row)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings

# Split pattern for words: any run of characters that are neither letters nor digits.
WORD_SPLIT = r"[^\p{L}\p{N}]+"
# White space as Python's str.strip() sees it in our data (Spark's trim() only drops spaces).
_WS = r"[ \t\n\r\f\x0B]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and named (a lambda variable)."""
    return F.get(F.transform(F.array(value), body), 0)


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: str | Column) -> Column:
    """Lower-cased words of the whole text, empty pieces removed (no lambda, so plans
    that share a tokenized input canonicalize equal and Spark can reuse their shuffle)."""
    return F.array_remove(F.split(F.lower(col_of(c)), WORD_SPLIT, -1), F.lit(""))


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()`` equivalent for ASCII white space."""
    return F.regexp_replace(col_of(c), f"^{_WS}+|{_WS}+$", "")


def snake_name(name: str) -> str:
    return name.replace(" ", "_").replace("/", "_").lower()


def snake_columns(df: DataFrame) -> DataFrame:
    """Space and '/' become '_', then lower case; one projection for all columns (op 3)."""
    names = [snake_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, new in zip(df.columns, names):
        if new in seen:
            raise ValueError(f"columns {seen[new]!r} and {old!r} both become {new!r}")
        seen[new] = old
    return df.toDF(*names)


def combine_text(df: DataFrame, cols: list[str], sep: str = "\n", out: str = "search_text") -> DataFrame:
    """Free-text fields joined into one search text, null fields skipped (op 20)."""
    return df.withColumn(out, F.concat_ws(sep, *[F.col(c) for c in cols]))


def prefix_question(df: DataFrame, col: str = "question", out: str = "question") -> DataFrame:
    """Question prefix for the structured answerer (op 36)."""
    return df.withColumn(out, F.concat(F.lit(settings.QUESTION_PREFIX), F.col(col)))


# Named character references as the HTML standard lists them (the table of the Python library); those
# that the standard also reads without ';' have an entry of their own without it.
_NAMED = {name: chars for name, chars in html5.items() if name.endswith(";")}
_LEGACY = {name: chars for name, chars in html5.items() if not name.endswith(";")}
# FIXED VALUES: numeric references 128 to 159 mean the characters of Windows-1252.
_CP1252 = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
_REFERENCE = r"^(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)"


#: Names that nearly all references use: found without the table.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;")


def _by_start(table: dict[str, str]) -> Column:
    """The table as one literal: first two characters -> name -> text, so a look-up scans a few names only."""
    grouped: dict[str, dict[str, str]] = {}
    for name, chars in sorted(table.items()):
        grouped.setdefault(name[:2], {})[name] = chars
    return F.from_json(F.lit(json.dumps(grouped)), "map<string,map<string,string>>")


def _look_up(table: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.try_element_at(_by_start(table), F.substring(name, 1, 2)), name)


def _code_point(c: Column) -> Column:
    """Character of a code point; 0, surrogates and what is beyond the last one give U+FFFD."""
    bad = c.isNull() | (c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF)
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(c)
    return F.coalesce(_look_up({str(n): chars for n, chars in _CP1252.items()}, safe.cast("string")),
                      F.decode(F.unhex(F.lpad(F.hex(safe.cast("bigint")), 8, "0")), "UTF-32"))


def _number(ref: Column) -> Column:
    digits = F.regexp_replace(ref, "[#xX;]", "")
    return F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")


def _without_semicolon(p: Column) -> Column:
    return let(F.regexp_extract(p, _LEGACY_NAME, 0), lambda name: F.when(name != "", F.concat(
        _look_up(_LEGACY, name), F.substring(p, F.length(name) + 1, F.length(p)))).otherwise(F.concat(F.lit("&"), p)))


def _decode_reference(p: Column, ref: Column) -> Column:
    rest = F.substring(p, F.length(ref) + 1, F.length(p))
    common = F.lit(None).cast("string")
    for name in reversed(_COMMON):
        common = F.when(ref == name, F.lit(_NAMED[name])).otherwise(common)
    return (F.when(F.startswith(ref, F.lit("#")), F.concat(let(_number(ref), _code_point), rest))
            .when(ref == "", _without_semicolon(p))
            .otherwise(F.coalesce(F.concat(F.coalesce(common, _look_up(_NAMED, ref)), rest), _without_semicolon(p))))


def _decode_piece(p: Column) -> Column:
    """Text after an '&': its reference decoded, or the '&' and the text as they are."""
    return let(F.regexp_extract(p, _REFERENCE, 0), lambda ref: _decode_reference(p, ref))


# of names without ';' the longest one wins
_LEGACY_NAME = "^(?:" + "|".join(sorted(_LEGACY, key=lambda n: (-len(n), n))) + ")"


def decode_references(c: Column) -> Column:
    """Character references (named, decimal, hexadecimal) decoded once, left to right."""
    pieces = F.split(c, "&", -1)
    return F.when(c.contains("&"), F.concat(F.get(pieces, 0), F.array_join(
        F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), _decode_piece), ""))).otherwise(c)


def html_text(c: str | Column) -> Column:
    """Visible text of an HTML page (op 42): script/style bodies, comments, doctype and
    tags (with '>' inside quoted attributes) removed, character references decoded, no
    separator added between elements. A script, style or comment that never closes runs to the end."""
    x = col_of(c)
    x = F.regexp_replace(x, r"(?is)<script\b.*?(?:</script\s*>|\z)", "")
    x = F.regexp_replace(x, r"(?is)<style\b.*?(?:</style\s*>|\z)", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?(?:-->|\z)", "")
    x = F.regexp_replace(x, r"<[/!?a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", "")
    x = F.regexp_replace(x, r"<[/!?a-zA-Z][^>]*>", "")          # tags whose quotes don't close
    return decode_references(x)


def user_prefix(email: str | Column) -> Column:
    """Name part of an e-mail with '.' -> '_'; first 4 characters + its length, zero padded
    to 3 digits but never cut (op 60)."""
    name = F.replace(F.split_part(col_of(email), F.lit("@"), F.lit(1)), F.lit("."), F.lit("_"))
    n = F.length(name).cast("string")
    padded = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    return F.concat(F.substring(name, 1, 4), padded)
