import pytest
from helpers import obs_frame, rental, sale, square
from pyspark.sql import functions as F

from quartermark.plans import impute as I
from quartermark.plans import spatial as P
from quartermark.schemas import schema
from quartermark.sources.readers import POLYGON


def cross(spark, pairs=(("20001", "L1"),)):
    return spark.createDataFrame([(a, b, b) for a, b in pairs], schema("crosswalk"))


def test_class_a_is_the_count_weighted_mean(spark):
    rows = [r for b, m, c in (("2", 400, 10), ("3", 500, 30), ("4", 600, 10)) for r in rental("house", b, m, c, geospatial_type="lga")]
    got = {r.statistic: r.value for r in I.impute_a(obs_frame(spark, rows)).collect()}
    assert got == {"median": 500.0, "count": 50.0}


def test_class_a_needs_both_statistics(spark):
    assert I.impute_a(obs_frame(spark, rental("house", "2", 400) + rental("house", "3", 500, 0))).count() == 0


def test_class_c_weights_by_rented_stock(spark):
    rows = []
    for d, beds in (("unit", (("1", 10), ("2", 20), ("3", 10))), ("house", (("2", 30), ("3", 40), ("4", 30)))):
        for b, c in beds:
            rows += rental(d, b, 400, c)
    o = obs_frame(spark, rows + [sale("unit", 500_000), sale("house", 800_000)])
    c = I.impute_c(o.unionByName(I.impute_a(o))).collect()
    assert len(c) == 1 and c[0].value == pytest.approx(714_285.714285, rel=1e-9)


def test_class_c_without_weights_is_the_mean(spark):
    c = I.impute_c(obs_frame(spark, [sale("unit", 500_000), sale("house", 800_000)])).collect()
    assert c[0].value == 650_000


def test_class_b_splits_by_rental_ratio(spark):
    rows = [r for b, m in (("2", 400), ("3", 600), ("4", 800)) for r in rental("house", b, m, 10, geospatial_codes="20001-20002")]
    o = obs_frame(spark, rows + [sale("house", 900_000)])
    got = {r.bedrooms: r.value for r in I.impute_b(o.unionByName(I.impute_a(o))).collect()}
    assert got == pytest.approx({"2": 600_000, "3": 900_000, "4": 1_200_000})


def test_class_d_over_the_spatial_crosswalk(spark):
    subs = spark.createDataFrame([("S1", "s1", square(0.0, 0.0)), ("S2", "s2", square(1.0, 0.0))], f"code string, name string, geom {POLYGON}")
    lga = spark.createDataFrame([("L1", "l1", square(0.0, 0.0, 2.0, 1.0))], f"code string, name string, geom {POLYGON}")
    o = obs_frame(spark, [sale("house", 800_000, geospatial_codes="S1"), sale("house", 600_000, geospatial_codes="S2")])
    got = I.impute_d(o, P.crosswalk(subs, lga)).collect()
    assert [(r.geospatial_codes, r.value, r.geospatial_type) for r in got] == [("L1", 700_000.0, "lga")]


def test_impute_twice_changes_nothing(spark):
    rows = [r for b, m in (("2", 400), ("3", 600)) for r in rental("house", b, m, 10, geospatial_codes="20001-20002")]
    o = obs_frame(spark, rows + [sale("house", 900_000), sale("unit", 500_000)])
    once = I.impute(o, cross(spark))
    twice = I.impute(once, cross(spark))
    assert once.count() == twice.count() > o.count()
    assert once.exceptAll(twice).count() == 0
    assert once.filter(~F.col("source_file").startswith("imputed:")).count() == o.count()


def test_code_match_is_not_a_plain_substring(spark):
    from quartermark.operators.joins import containment_join

    single = spark.createDataFrame([("20031", 1), ("20031-20032", 1)], "geospatial_codes string, k int")
    groups = spark.createDataFrame([("120031", 1), ("20031-20032", 1), ("20031-20031", 1), ("20099-20031-20032", 1)], "geospatial_codes string, k int")
    got = sorted((r.geospatial_codes, r.group_codes) for r in containment_join(single, groups, ["k"]).collect())
    assert got == [
        ("20031", "20031-20031"), ("20031", "20031-20032"), ("20031", "20099-20031-20032"),
        ("20031-20032", "20031-20032"), ("20031-20032", "20099-20031-20032"),
    ]
