import pytest
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import aggs, quality, sets, windows

CASES = [
    ((0, 0), (0, 79), (0, 79), {"imp_minus_obs": quality.P1, "fc_minus_obs": quality.P1}),
    ((0, 203), (0, 754), (0, 0), {"imp_minus_obs": quality.P4}),
    ((0, 747), (0, 201), (0, 0), {"obs_minus_imp": quality.P2}),
    ((0, 79), (0, 0), (0, 73), {"obs_minus_fc": quality.P3}),
    ((0, 3), (0, 2), (0, 0), {"obs_minus_imp": quality.P5}),
]


@pytest.mark.parametrize("obs,imp,fc,want", CASES)
def test_lineage_patterns(spark, obs, imp, fc, want):
    p = spark.range(800).select(
        F.lit("sal").alias("tier"), F.lit("house").alias("dwelling_type"), F.lit("2").alias("bedrooms"), F.col("id").cast("string").alias("polygon"),
        *[((F.col("id") >= a) & (F.col("id") < b)).alias(n) for n, (a, b) in (("obs", obs), ("imp", imp), ("fc", fc))],
    ).filter("obs or imp or fc")
    got = {r.pair: r.pattern for r in quality.classify_diffs(p, sets.pairwise_diffs(p)).collect()}
    assert {k: got.get(k) for k in want} == want


def test_coverage_pivot_is_one_record(spark):
    rows = [("sal", "house", "2", c, n) for c, n in (("observed", 138), ("imputed", 622), ("forecast", 760))]
    cov = spark.createDataFrame(rows, "tier string, dwelling_type string, bedrooms string, source_class string, region_count long")
    assert [tuple(r)[3:] for r in aggs.coverage_pivot(cov).collect()] == [(138, 622, 760)]


def test_file_name_levels(spark):
    names = ["Secondary_Integrated_Year12_2026.geojson", "Primary_Integrated_2026.geojson", "Standalone_singlesex_2026.geojson"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(C.level_slug("n")).collect()] == ["secondary_year12", "primary", "standalone_singlesex"]


def test_labels(spark):
    df = spark.createDataFrame([("all", "all"), ("house", "2"), ("house", "all"), ("all", "3")], "dwelling_type string, bedrooms string")
    assert [r[0] for r in df.select(C.slice_label()).collect()] == ["All dwellings", "House · 2 br", "House", "All · 3 br"]
    v = spark.createDataFrame([(1.5,), (12345.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in v.select(C.variance_label("v")).collect()] == ["1.500", "1.23e+4", "—", "—"]


def test_ramp(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0), (10.0, 0.0, 10.0), (5.0, 0.0, 10.0), (3.0, 3.0, 3.0)], "v double, lo double, hi double")
    got = [r[0] for r in df.select(C.ramp_colour("v", "lo", "hi")).collect()]
    assert got[0] == [68, 1, 84] and got[1] == [39, 173, 129] and got[3] == [68, 1, 84] and got[2] == [52, 97, 141]


def test_running_sums_with_one_hot_key(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("v"))
    got = windows.running_sums(rows.repartition(5), ["k"], ["id"], {"s": F.col("v")})
    want = rows.withColumn("s", F.sum("v").over(windows.W.partitionBy("k").orderBy("id")))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    idx = windows.row_index(rows.repartition(5), [], ["id"])
    assert idx.filter(F.col("idx") != F.col("id")).count() == 0


def test_ema_matches_the_recurrence(spark):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 2).alias("k"), F.sin(F.col("id").cast("double")).alias("v"))
    got = {r.k: r.ema for r in windows.ema(rows.repartition(4), ["k"], ["id"], "v", 0.1, 60.0).collect()}
    for k in (0, 1):
        e = 60.0
        for r in sorted(rows.filter(F.col("k") == k).collect()):
            e = e * 0.9 + 0.1 * r.v
        assert got[k] == pytest.approx(e)
