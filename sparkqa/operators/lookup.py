"""Left join of a few rows against a big table without shuffling the big table.

``rows LEFT JOIN table`` can only broadcast its right side, the big table; with few rows
on the left, Spark would shuffle the whole table (e.g. every document text) to attach a
handful of matches. Here the rows are written once (so the planner knows their real
size), inner-joined as the build side (broadcast while under
``autoBroadcastJoinThreshold``, sort-merge join beyond it), and rows without a match are
added back with nulls through a small anti-join on a row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def left_lookup(rows: DataFrame, table: DataFrame, row_key: str, table_key: str,
                label: str = "lookup") -> DataFrame:
    """Same rows and columns as ``rows.join(table, rows[row_key] == table[table_key], "left")``."""
    r = materialize(rows.withColumn("_rid", F.monotonically_increasing_id()), label)
    # matches are few rows: written once, so that the table is scanned once for both branches
    found = materialize(r.join(table, r[row_key] == table[table_key], "inner"), f"{label}-found")
    missing = r.join(found.select("_rid"), "_rid", "left_anti")
    return found.unionByName(missing, allowMissingColumns=True).drop("_rid")
