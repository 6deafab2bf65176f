"""Markdown pipe tables in model replies -> rows and JSON (ops 37-39)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from .text import strip_ws


def _cells(line):
    return F.transform(F.split(line, r"\|", -1), lambda c: strip_ws(c))


def _named(hdr, idx):
    """Header positions that name a column: non-empty, and the last of repeated names
    (a repeated header keeps the value of its last column)."""
    return F.filter(idx, lambda i: (F.try_element_at(hdr, i) != "")
                    & ~F.array_contains(F.slice(hdr, i + 1, F.greatest(F.size(hdr), F.lit(1))),
                                        F.try_element_at(hdr, i)))


def markdown_rows(df: DataFrame, col: str = "reply", key: str = "conv_id") -> DataFrame:
    """One row per body line of a pipe table (op 37).

    The first line is the header, the second (separator) is skipped, blank lines are
    ignored, cells are trimmed, columns with an empty name are dropped. Short rows get
    null cells, extra cells are dropped. Output: key, row_no (1-based), ``cells`` map in
    header order."""
    lines = F.filter(F.split(F.col(col), "\n", -1), lambda l: strip_ws(l) != "")
    x = df.select(key, _cells(F.try_element_at(lines, F.lit(1))).alias("hdr"),
                  F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))).alias("body"))
    x = x.select(key, "hdr", F.posexplode("body").alias("pos", "line"))
    cells = _cells(F.col("line"))
    idx = F.sequence(F.lit(1), F.size("hdr"))
    named = _named(F.col("hdr"), idx)
    keys = F.transform(named, lambda i: F.try_element_at(F.col("hdr"), i))
    vals = F.transform(named, lambda i: F.get(cells, i - 1))
    return x.select(key, (F.col("pos") + 1).alias("row_no"), F.map_from_arrays(keys, vals).alias("cells"))


def markdown_json(df: DataFrame, col: str = "reply", key: str = "conv_id") -> DataFrame:
    """The same rows as one compact JSON array per reply, in line order (op 38).
    Computed inside each row: no regrouping, no shuffle."""
    return df.select(key, table_json_expr(col).alias("json"))


def table_json_expr(col: str):
    """Markdown table -> JSON array text inside one row, without regrouping (used by op 39)."""
    lines = F.filter(F.split(F.col(col), "\n", -1), lambda l: strip_ws(l) != "")
    hdr = _cells(F.try_element_at(lines, F.lit(1)))
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    idx = F.sequence(F.lit(1), F.size(hdr))
    named = _named(hdr, idx)
    keys = F.transform(named, lambda i: F.try_element_at(hdr, i))

    def row(line):
        cells = _cells(line)
        return F.map_from_arrays(keys, F.transform(named, lambda i: F.get(cells, i - 1)))

    return F.to_json(F.transform(body, row))


def format_structured(df: DataFrame, col: str = "reply", out: str = "answer") -> DataFrame:
    """More than one '|' -> the table as JSON, else the text unchanged; then the answer
    prefix (op 39)."""
    body = F.when(F.regexp_count(F.col(col), F.lit(r"\|")) > 1, table_json_expr(col)).otherwise(F.col(col))
    return df.withColumn(out, F.concat(F.lit(settings.ANSWER_PREFIX), body))
