"""Medians by value ranges beside sorted lists."""

import math
import random
import statistics

from pyspark.sql import functions as F

from quartermark.operators import aggs, medians


def both(spark, rows, buckets):
    df = spark.createDataFrame(rows, "k string, v double")
    counted = df.filter("v is not null").groupBy(F.struct("k").alias("group"), F.col("v").alias("value")).agg(F.count("*").alias("n"))
    return {r.group.k: r.median for r in medians.by_ranges(counted, buckets).collect()}


def test_ranges_equal_sorted_middle(spark):
    rng = random.Random(3)
    groups = {
        "even": [rng.uniform(-5, 5) for _ in range(400)],
        "odd": [rng.lognormvariate(0, 30) for _ in range(301)],
        "ties": [rng.randrange(3) for _ in range(500)],
        "one": [7.5],
        "two": [-1e308, 1.7e308],
        "tiny": [5e-324, 1e-323, 1.5e-323],
        "far": [*range(50), 1e300, -1e300, 1e12],
        "same": [2.0] * 9,
        None: [1.0, 2.0, 4.0, 9.0],
    }
    got = both(spark, [(k, float(v)) for k, vs in groups.items() for v in vs], 16)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = sorted(map(float, vs))
        want = s[(len(s) - 1) // 2] / 2 + s[len(s) // 2] / 2 if abs(s[0]) > 1e307 else statistics.median(s)
        assert math.isclose(got[k], want, rel_tol=1e-15), k


def test_infinite_values_and_nan(spark):
    inf, nan = math.inf, math.nan
    got = both(spark, [("a", -inf), ("a", 1.0), ("a", inf), ("b", inf), ("b", inf), ("b", 0.0), ("c", nan), ("c", nan), ("c", 1.0), ("d", -inf), ("d", -inf), ("d", nan)], 4)
    assert got["a"] == 1.0 and got["b"] == inf and math.isnan(got["c"]) and got["d"] == -inf


def test_nulls_empty_and_paths_agree(spark):
    rows = [("a", None), ("a", 3.0), ("a", 1.0), ("b", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = [(None, 5.0, 1), ("a", 2.0, 3), ("b", None, 1)]
    for held in (0, 100):
        got = [tuple(r) for r in medians.median(df, ["k"], "v", held).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert medians.median(df.limit(0), ["k"], "v", held).count() == 0
    assert {r.k for r in aggs.cluster_median(df, ["k"], "v", 2).collect()} == {"a"}
