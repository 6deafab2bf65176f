"""Latency sketches: error bound against exact percentiles, merging, rewritten days, edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sparkqa import fixtures as fx
from sparkqa.operators import sketches

PS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def calls(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, span string, ms double")


def nearest_rank(values, p):
    return sorted(values)[max(1, math.ceil(len(values) * p)) - 1]


def test_within_the_bound_of_exact_percentiles(spark, tmp_path):
    import datetime as dt
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(3, 2, 3000), -rng.lognormal(0, 1, 300), np.zeros(50), [1e-9, 123456789.5]])
    start = dt.datetime(2024, 1, 30)
    rows = [(start + dt.timedelta(hours=int(h)), "hot" if h % 3 else "cold", float(v)) for h, v in zip(rng.integers(0, 90, len(values)), values)]
    path = str(tmp_path / "days")
    sketches.write_days(sketches.day_sketches(calls(spark, rows), ["span"], "ms"), path)
    for first, last in ((None, None), ("2024-01-31", "2024-02-01")):
        got = sketches.percentiles(sketches.read_days(spark, path, first, last), ["span"], PS).collect()
        chosen = [r for r in rows if first is None or first <= r[0].date().isoformat() <= last]
        assert {r.span for r in got} == {"hot", "cold"}
        for r in got:
            mine = [v for _, s, v in chosen if s == r.span]
            assert r.calls == len(mine)
            for name, p in PS.items():
                exact = nearest_rank(mine, p)
                assert abs(r[name] - exact) <= abs(exact) * 2.0 ** -sketches.BITS + 1 / sketches.UNITS, (name, exact, r[name])


def test_days_merge_to_one_pass_and_a_day_is_replaced(spark, tmp_path):
    trace = fx.trace(spark, SF_SMALL)
    path = str(tmp_path / "days")
    days = sketches.day_sketches(trace, ["span"], "latency_ms")
    sketches.write_days(days, path)
    one_pass = days.groupBy("span", "bucket").agg(F.sum("n").alias("n"))
    want = sorted(map(tuple, sketches.percentiles(one_pass, ["span"], PS).collect()))
    assert sorted(map(tuple, sketches.percentiles(sketches.read_days(spark, path), ["span"], PS).collect())) == want
    day = days.agg(F.min("day")).first()[0]
    sketches.write_days(days.filter(F.col("day") == F.lit(day)), path)      # again: nothing is counted twice
    assert sorted(map(tuple, sketches.percentiles(sketches.read_days(spark, path), ["span"], PS).collect())) == want


def test_null_nan_and_endless_values(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "a", None), (t, "a", float("nan")), (t, "a", 2.0), (t, "b", None), (t, None, float("inf")), (None, None, -1.0)]
    got = {r.span: tuple(r)[1:] for r in sketches.percentiles(
        sketches.day_sketches(calls(spark, rows), ["span"], "ms"), ["span"], {"p50": 0.5}).collect()}
    assert got["a"][0] == 3 and abs(got["a"][1] - 2.0) <= 2.0 * 2.0 ** -8 + 0.001
    assert got["b"] == (1, None)
    assert got[None][0] == 2 and abs(got[None][1] + 1.0) <= 0.01
    assert sketches.percentiles(sketches.day_sketches(calls(spark, []), ["span"], "ms"), ["span"], {"p50": 0.5}).count() == 0
