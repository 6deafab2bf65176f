"""CSV source and table sinks (ops 1, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = True) -> DataFrame:
    """Headered, comma-delimited CSV with a declared schema (StructType or DDL), no inference (op 1).

    ``multiLine`` + ``escape='"'`` read quoted newlines and doubled quotes correctly.
    A multi-line file cannot be split, so large inputs should arrive as many files;
    with ``multiline=False`` files are split by ``spark.sql.files.maxPartitionBytes``."""
    return (spark.read.option("header", "true").option("delimiter", ",")
            .option("multiLine", str(multiline).lower()).option("escape", '"')
            .option("mode", "FAILFAST")
            .schema(schema).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Write a frame as headered CSV that ``read_csv`` reads back unchanged."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Drop-and-create with the frame's schema, then all rows; running twice leaves one
    copy (op 7). The frame must not read from ``path`` itself."""
    df.write.mode("overwrite").format(fmt).save(path)


def check_columns(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet") -> list[str]:
    """Columns of the table at ``path``; raises if the frame's differ in name or type."""
    target = spark.read.format(fmt).load(path).schema
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in target.fields}
    missing = sorted(set(want) - set(have))
    extra = sorted(set(have) - set(want))
    wrong = sorted(n for n in set(want) & set(have) if want[n] != have[n])
    if missing or extra or wrong:
        raise ValueError(f"schema mismatch: missing={missing} extra={extra} type={wrong}")
    return target.names


def append_table(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows, matching columns by name (op 8). Raises before writing on a missing,
    extra or differently typed column."""
    df.select(*check_columns(spark, df, path, fmt)).write.mode("append").format(fmt).save(path)
