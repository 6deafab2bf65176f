"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table

__all__ = ["SPACE", "by_batch", "crc_of_id", "fresh", "held_out", "materialize", "parallelism", "table"]

#: Character class of the white space the contracts name: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"


def parallelism(spark: SparkSession) -> int:
    """Tasks a shuffle of this session is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str) -> Column:
    """CRC-32 of the identifier written as text (a null identifier counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def held_out(column: str, folds: int) -> Column:
    """True for rows of fold 0: models learn from the other folds only."""
    return F.pmod(crc_of_id(column), F.lit(folds)) == 0


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` (whatever its case) is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """An Arrow batch function as the iterator function that ``mapInArrow`` takes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return run
