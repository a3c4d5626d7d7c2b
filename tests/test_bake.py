from datetime import date

from pyspark.sql import functions as F

from quartermark.operators import quality
from quartermark.plans.bake import bake
from quartermark.plans.series import infer_grid
from quartermark.schemas import TABLES
from quartermark.workload import base as B
from quartermark.workload import spatial as SP

SF = "/root/testdata/sf0.001"


def test_bake_writes_consistent_tables(spark, tmp_path):
    cpi = B.cpi(spark, SF).filter(F.col("region") == B.INDEX_REGION)
    regions = SP.squares(spark, SF).drop("p")
    # Two half-rows as parents, so that they touch.
    halves = regions.filter(F.col("code").isin("20000", "20005")).select(
        F.col("code"), F.col("name"), F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(
            (F.get(r, 0)["x"] + (v["x"] - F.get(r, 0)["x"]) * 5).alias("x"), v["y"].alias("y"))))).alias("geom")
    )
    made = bake(B.obs(spark, SF), regions, halves, cpi, str(tmp_path), B.TODAY, [2, 5], [1], target=date(2002, 12, 31))
    assert set(made) == set(TABLES) - {"cluster_linkage"}
    counts = {k: v.count() for k, v in made.items()}
    assert all(counts.values()), counts
    fc, models = made["forecasts"], made["forecast_models"]
    assert fc.join(models, "series_id", "left_anti").count() == 0
    assert fc.filter("data_type = 'rental'").filter(F.month("ds").isin(3, 6, 9, 12)).count() == fc.filter("data_type = 'rental'").count()
    assert infer_grid(fc.filter("data_type = 'rental'")).first()[0] == "QS-DEC"
    ids = made["cluster_centroids"].select(F.col("cluster_id").alias("provenance_cluster_id"))
    assert made["yields"].filter("source = 'cluster_fallback'").join(ids, "provenance_cluster_id", "left_anti").count() == 0
    assert made["geographic_hierarchy"].filter("tier = 'sal'").count() == 20
    assert quality.check_provenance(fc).first().direct_with_cluster == 0
    assert spark.read.json(f"{tmp_path}/meta").first().seed == 42
