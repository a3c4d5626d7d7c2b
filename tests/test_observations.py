"""Medians of observations are sorted once, keys stay numbers; class A is derived once for coverage."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quartermark.plans import impute as I
from quartermark.workload import QUERIES
from quartermark.workload import base as B

SF = "/root/testdata/sf0.001"


def items(spark, tmp_path, rows):
    """line items (suppkey, partkey, linenumber, quantity, price, ship date) as a table of their own."""
    cols = "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_observations_sort_instead_of_merging_buffers(spark):
    plan = B.obs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Window") >= 3


def test_medians_of_even_odd_null_and_missing_values(spark, tmp_path):
    d = datetime(2001, 5, 7)
    rows = [(18, 3, 2, 1.0, v, d) for v in (15.0, 3.0, 24.0, None)] + [(18, 3, 1, 1.0, v, d) for v in (12.0, 21.0)]
    rows += [(18, None, 2, 1.0, None, d), (27, 4, None, 1.0, 30.0, None)]
    got = {
        (r.geospatial_codes, r.dwelling_type, r.bedrooms, r.statistic, r.data_type): r.value
        for r in B.obs(spark, items(spark, tmp_path, rows)).collect()
    }
    # Supplier 18 is not let (its last digit is 8), but sold.
    assert not [k for k in got if k[0] in ("20018", "90001") and k[4] == "rental"]
    assert got["20018", "house", "all", "median", "sales"] == 150.0
    assert ("20018", "unit", "all", "median", "sales") not in got
    # Supplier 27 is a suburb of its own; no line number counts as a unit, no ship date is its own bucket.
    assert got["20027", "unit", "2", "median", "rental"] == 10.0 and got["20027", "unit", "2", "count", "rental"] == 1.0
    assert got["90002", "all", "all", "median", "rental"] == 10.0


def test_rental_medians_equal_the_percentile(spark):
    li = B.table(spark, SF, "lineitem").filter(F.col("l_suppkey") % 10 < 8)
    month = F.make_date(F.year("l_shipdate"), F.quarter("l_shipdate") * 3, F.lit(1))
    rent = F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 3)
    want = li.groupBy((F.floor(F.col("l_suppkey") / 10) + 90000).cast("string").alias("geospatial_codes"), month.alias("time_bucket")).agg(F.median(rent).alias("value"))
    got = B.obs(spark, SF).filter("geospatial_type = 'lga' and dwelling_type = 'all' and statistic = 'median'").select(want.columns)
    assert want.count() > 10 and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("name", ["E13_coverage_pivot", "M6_absence_reason"])
def test_coverage_derives_class_a_once(spark, monkeypatch, name):
    made, one = [], I.impute_a
    monkeypatch.setattr(I, "impute_a", lambda rows: made.append(1) or one(rows))
    QUERIES[name](spark, SF)
    assert len(made) == 1


def test_imputation_writes_no_observed_row(spark, monkeypatch):
    written, one = [], I.cut
    monkeypatch.setattr(I, "cut", lambda df, *a: written.append(df) or one(df, *a))
    I.impute(B.obs_table(spark, SF), B.crosswalk(spark, SF))
    assert written and all(df.filter(~F.col("source_file").startswith("imputed:")).isEmpty() for df in written)
