"""Appends that keep a key unique without reading the whole table (ops 8, 10).

Beside the table lies one Bloom filter for every file, cut into ``BLOCKS`` by the hash of the key. An append tests its
keys against the filters block by block and then compares them with the keys of those files alone that may hold one.
A filter errs on one side: a file without a hit holds none of the keys. Filters belong to files, so files that arrive by other
ways get theirs at the next append, and a replaced table starts anew. One writer at a time."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import key_violations
from ..session import materialize, path_exists
from .files import append_table, check_columns

FILTERS = "_key_filters"     # readers of the table skip folders that begin with an underscore
BLOCKS = 64                  # parts of a file's filter, by key hash
BITS_PER_KEY = 16            # with 8 probes about one key in 2,000 hits a file that lacks it
PROBES = 8
FILES_PER_GROUP = 1000       # filters that one group of keys is tested against


def _spots(h1: pd.Series, h2: pd.Series, size: int) -> np.ndarray:
    first, step = (h.to_numpy(np.int64).astype(np.uint64)[:, None] for h in (h1, h2))
    return (first + np.arange(PROBES, dtype=np.uint64) * (step | np.uint64(1))) % np.uint64(size)


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    h1 = F.xxhash64(*keys)
    return df.withColumns({"h1": h1, "h2": F.xxhash64(F.lit(1), *keys), "block": F.pmod(h1, F.lit(BLOCKS)).cast("int")})


def _plain(path: str) -> str:
    return re.sub(r"^[a-z0-9]+:/+", "/", path)


def _folder(path: str, keys: list[str]) -> str:
    return f"{path}/{FILTERS}/{hashlib.sha256(repr(keys).encode()).hexdigest()[:16]}"      # filters of one list of key columns


def add_filters(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Writes the filters of the files that have none yet; only their key columns are read."""
    folder = _folder(path, keys)
    known = {r.file for r in spark.read.parquet(folder).select("file").distinct().collect()} if path_exists(spark, folder) else set()
    new = [f for f in spark.read.parquet(path).inputFiles() if _plain(f) not in known]
    if not new:
        return

    def fill(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = len(pdf) * BITS_PER_KEY
        bits = np.zeros(size, dtype=bool)
        bits[_spots(pdf["h1"], pdf["h2"], size).ravel()] = True
        return pd.DataFrame({"file": [group[0]], "block": [group[1]], "size": [size], "bits": [np.packbits(bits).tobytes()]})

    name = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:/+", "/").alias("file")
    rows = _hashed(spark.read.parquet(*new).select(*keys, name), keys).select("file", "block", "h1", "h2")
    rows.groupBy("file", "block").applyInPandas(fill, "file string, block int, size long, bits binary") \
        .write.mode("append").parquet(folder)


def candidate_files(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> list[str]:
    """Files of the table that may hold a key of ``df``, by their filters."""
    add_filters(spark, path, keys)
    files = {_plain(f): f for f in spark.read.parquet(path).inputFiles()}
    groups = -(-max(len(files), 1) // FILES_PER_GROUP)
    filters = spark.read.parquet(_folder(path, keys)).withColumn("part", F.pmod(F.xxhash64("file"), F.lit(groups)).cast("int")) \
        if files else None
    if filters is None:
        return []

    def test(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        found = []
        for name, size, bits in zip(old["file"], old["size"], old["bits"]) if len(new) else ():
            spots = _spots(new["h1"], new["h2"], size)
            if ((np.frombuffer(bits, np.uint8)[spots >> np.uint64(3)] >> (7 - (spots & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1).any():
                found.append(name)
        return pd.DataFrame({"file": pd.Series(found, dtype=object)})

    asked = _hashed(df.select(*keys), keys).select("block", "h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    hit = asked.groupBy("block", "part").cogroup(filters.groupBy("block", "part")).applyInPandas(test, "file string").distinct()
    return sorted(files[r.file] for r in hit.collect() if r.file in files)         # names of files, not rows


def append_unique(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends like ``append_table`` if no key is null, repeated in ``df`` or in the table already; otherwise raises before
    anything is written. Returns how many files of the table were compared."""
    check_columns(spark, df, path)
    df = materialize(df, "append")           # checked and written as the same rows
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"null or repeated keys: {[tuple(r) for r in bad]}")
    files = candidate_files(spark, df, path, keys)
    if files:
        held = df.select(*keys).join(spark.read.parquet(*files).select(*keys), keys, "left_semi").limit(5).collect()
        if held:
            raise ValueError(f"keys that the table holds: {[tuple(r) for r in held]}")
    append_table(spark, df, path)
    add_filters(spark, path, keys)
    return len(files)
