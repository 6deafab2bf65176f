"""Table checks as jobs: counts, schema report, preview, NOT NULL and PRIMARY KEY (ops 4-6, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame (op 4)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullable, null count (op 5).

    All null counts come from a single aggregate pass, unpivoted with ``stack``."""
    fields = df.schema.fields
    counts = df.agg(*[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"c{i}") for i, f in enumerate(fields)])
    stack_args = ", ".join(f"{i + 1}, c{i}" for i in range(len(fields)))
    long = counts.selectExpr(f"stack({len(fields)}, {stack_args}) AS (position, null_count)")
    meta = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)],
        "position int, name string, type string, nullable boolean")
    return meta.join(long, "position").select("position", "name", "type", "nullable", "null_count")


def preview(df: DataFrame, key: str | list[str], n: int = 10) -> DataFrame:
    """First n rows in key order, repeatable (op 6): a TakeOrderedAndProject, no full sort."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*keys).limit(n)


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """NOT NULL as a job: null count per declared non-null column, one pass (op 9)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack_args = ", ".join(f"'{c}', `{c}`" for c in cols)
    return counts.selectExpr(f"stack({len(cols)}, {stack_args}) AS (column_name, null_count)")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """PRIMARY KEY as a job: key values seen more than once (with counts) and null keys (op 10).

    ``groupBy(keys).count()`` combines map-side, so a hot key costs one partial row per
    input partition, not one row per occurrence."""
    any_null = None
    for k in keys:
        any_null = F.col(k).isNull() if any_null is None else (any_null | F.col(k).isNull())
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.filter((F.col("n") > 1) | any_null).withColumn(
        "violation", F.when(any_null, F.lit("null key")).otherwise(F.lit("duplicate key")))
