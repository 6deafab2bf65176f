"""Appends that keep keys unique: refused before writing, few files compared, foreign and replaced files."""

import pytest

from sparkqa.sources import files, unique


def rows(spark, first, last):
    return spark.range(first, last, 1, 1).selectExpr("id AS k", "cast(id % 7 AS string) AS g", "id * 0.5D AS v")


def test_append_unique(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(rows(spark, 0, 1000), path)
    for at in range(1, 6):                     # these files arrive without filters
        files.append_table(spark, rows(spark, at * 1000, at * 1000 + 1000), path)
    count = lambda: spark.read.parquet(path).count()
    assert unique.append_unique(spark, rows(spark, 9000, 9020), path, ["k", "g"]) <= 1
    assert count() == 6020
    # a key of one file: refused, and that file is the one compared (a chance hit beside it is allowed)
    twice = rows(spark, 2500, 2501).unionByName(rows(spark, 9500, 9510))
    assert 1 <= len(unique.candidate_files(spark, twice, path, ["k", "g"])) <= 2
    for bad in (twice, rows(spark, 9000, 9001), rows(spark, 9600, 9601).unionByName(rows(spark, 9600, 9601)),
                rows(spark, 9700, 9701).selectExpr("cast(NULL AS bigint) AS k", "g", "v"), rows(spark, 9800, 9801).drop("v")):
        with pytest.raises(ValueError):
            unique.append_unique(spark, bad, path, ["k", "g"])
    assert count() == 6020
    unique.append_unique(spark, rows(spark, 0, 0), path, ["k", "g"])      # nothing to append
    assert count() == 6020


def test_every_key_is_found_again(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(rows(spark, 0, 300), path)
    (only,) = unique.candidate_files(spark, rows(spark, 299, 300), path, ["k"])
    for k in (0, 77, 150):
        assert unique.candidate_files(spark, rows(spark, k, k + 1), path, ["k"]) == [only]
    assert unique.candidate_files(spark, rows(spark, 5, 6), path, ["k", "g"]) == [only]       # other keys, other filters
    files.replace_table(rows(spark, 500, 600), path)                       # the filters went with the table
    assert unique.append_unique(spark, rows(spark, 0, 10), path, ["k"]) <= 1
    assert spark.read.parquet(path).count() == 110
