"""The whole batch job: observations in, every derived table out.

Order: impute, hierarchy, models, yield bridge, corroboration, diagnostics, checks, run record. Each
table is written once and read back where a later step needs it, so no step repeats another's work.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.operators import aggs, joins, quality
from quartermark.plans import graph as K
from quartermark.plans import impute as I
from quartermark.plans import models as M
from quartermark.plans import series as S
from quartermark.plans import spatial as P
from quartermark.plans import yields as Y
from quartermark.schemas import METHODS, schema
from quartermark.session import cut
from quartermark.sources import sinks


def _save(df: DataFrame, out: str, table: str) -> DataFrame:
    path = f"{out}/{table}"
    sinks.write_parquet(sinks.conform(df, schema(table)), path)
    return df.sparkSession.read.schema(schema(table)).parquet(path)


def hierarchy(regions: DataFrame, obs: DataFrame, tier: str, cuts: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K8-K11, E19. Assignments, cluster aggregates and merges of one tier; regions have code, geom (degrees)."""
    plane = P.centroid_area(P.reproject(regions, 4326, 7855))
    nodes = plane.select(F.col("code").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    links = K.regional_linkage(nodes, P.touching_pairs(regions), tier)
    assigned = K.regionalise(nodes, links, cuts, tier)
    kind = "suburb" if tier == "sal" else "lga"
    rented = obs.filter(
        (F.col("geospatial_type") == kind) & (F.col("data_type") == "rental") & (F.col("statistic") == "median") & F.col("value").isNotNull()
    ).select(F.col("geospatial_codes").alias("node_id")).distinct().withColumn("has_rental", F.lit(True))
    shape = P.centroids_wgs84(regions).select(F.col("code").alias("node_id"), F.col("cx").alias("lon"), F.col("cy").alias("lat"), "area_km2")
    facts = shape.join(rented, "node_id", "left").withColumn("has_rental", F.coalesce("has_rental", F.lit(False)))
    return assigned, aggs.cluster_stats(assigned, facts), links


def bake(
    obs: DataFrame, regions: DataFrame, parents: DataFrame, cpi: DataFrame, out: str, today: date, cuts: list[int], parent_cuts: list[int],
    forward: int = 0, target: date = S.FORECAST_TARGET, seed: int = 42,
) -> dict[str, DataFrame]:
    """Write every table under `out` and return them. Checks fail the run before the run record is written."""
    spark = obs.sparkSession
    made: dict[str, DataFrame] = {}

    def save(df: DataFrame, table: str) -> DataFrame:
        made[table] = _save(df, out, table)
        return made[table]

    save(cpi, "cpi")
    cross = save(P.crosswalk(regions, parents), "crosswalk")
    rows = save(I.impute(cut(obs), cross), "rental_sales")

    sal, sal_stats, sal_links = hierarchy(regions, rows, "sal", cuts)
    lga, lga_stats, lga_links = hierarchy(parents, rows, "lga", parent_cuts)
    hier = save(sal.unionByName(lga), "geographic_hierarchy")
    save(sal_stats.unionByName(lga_stats), "cluster_centroids")
    save(sal_links.unionByName(lga_links), "linkage_matrix")

    # Quarterly rental with the index; the inner join leaves annual sales out by date.
    index_max = cpi.agg(F.max("time_bucket")).first()[0]
    ahead = S.forward_h(today, target, forward)
    padded = S.carry_forward(cpi, S.STALE_QUARTERS + ahead + 1)
    long = S.long_frame(rows)
    rental = long.filter(F.col("unique_id").startswith("rental|"))
    train = joins.with_exog(rental, cpi)
    fresh = S.quarters_to(today) <= S.STALE_QUARTERS
    # Each market is fitted once; forecasts and model rows are two views of the same written fit.
    fits_q = sinks.write_parquet(M.fit(train, S.quarters_to(today) + ahead, 4, 3, padded, keep=fresh), f"{out}/_fits_quarterly")
    sales = long.filter(F.col("unique_id").startswith("sales|"))
    years = S.years_to(max(today.year, target.year))
    keep = (years <= S.STALE_YEARS) & (F.col("n_obs") >= S.MIN_ANNUAL)
    fits_y = sinks.write_parquet(M.fit(sales, years, 1, 12, keep=keep), f"{out}/_fits_annual")
    fq, fy = spark.read.parquet(fits_q), spark.read.parquet(fits_y)
    modelled = S.annotate(S.valid_bands(M.forecast_rows(fq, 3)), today, index_max, "ar_cpi_q", "nowcast_sarima_cpi").unionByName(
        S.annotate(S.valid_bands(M.forecast_rows(fy, 12)), today, None, "ar_annual", "nowcast_sarima_annual")
    )

    direct = Y.direct_yields(rows)
    yields = save(direct.unionByName(Y.fallback_yields(rows, direct, hier)), "yields")
    forecasts = save(modelled.unionByName(Y.borrowed_sales(rows, yields, modelled, today)), "forecasts")
    quality.require_clean(quality.check_bands(forecasts), ["n_violations"])
    quality.require_clean(quality.check_provenance(forecasts), ["direct_with_cluster", "cluster_without_id"])
    quality.require_clean(quality.check_schema(forecasts, schema("forecasts"), {"imputation_method": METHODS}), ["n_null", "n_off_list"])

    classes = aggs.source_class(rows)
    fitted = S.model_table(fq, classes, today, "ar_cpi_q", "cpi").unionByName(S.model_table(fy, classes, today, "ar_annual", "none"))
    save(fitted.unionByName(S.borrowed_models(forecasts, fitted, classes, today)), "forecast_models")
    save(Y.corroborate(rows, hier), "forecast_diagnostics_corroboration")

    scores = M.backtest(train, cpi)
    unfilled = [f.name for f in schema("forecast_diagnostics") if f.name not in scores.columns]
    save(scores.withColumns({c: F.lit(None).cast("double") for c in unfilled}), "forecast_diagnostics")
    sinks.write_meta(spark, out, seed, today, index_max, {"spark": spark.version})
    return made
