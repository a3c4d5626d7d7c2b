"""2J: the bridge between the rental and the sales market."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import aggs, joins, windows
from quartermark.schemas import FORECAST_COLUMNS, YIELD_COLUMNS

WEEKS = 52


def _rental_medians(df: DataFrame, tier: str = "suburb") -> DataFrame:
    return df.filter(
        (F.col("data_type") == "rental")
        & (F.col("geospatial_type") == tier)
        & (F.col("statistic") == "median")
        & F.col("value").isNotNull()
    )


def _observed_sales(df: DataFrame) -> DataFrame:
    return df.filter(
        (F.col("data_type") == "sales")
        & (F.col("geospatial_type") == "suburb")
        & (F.col("statistic") == "median")
        & ~C.is_imputed()
        & F.col("value").isNotNull()
    ).select(
        "geospatial_codes", "dwelling_type", F.year("time_bucket").alias("year"), F.col("value").alias("sale_price")
    )


def direct_yields(df: DataFrame) -> DataFrame:
    """J13. Annual rent over sale price where a suburb has both in a year."""
    rent = aggs.annual_mean(
        _rental_medians(df).filter(F.col("dwelling_type").isin("house", "unit") & (F.col("bedrooms") != "all")),
        ["geospatial_codes", "dwelling_type"],
        factor=WEEKS,
        name="annual_rent",
    )
    keys = ["geospatial_codes", "dwelling_type", "year"]
    pairs = joins.containment_join(_observed_sales(df), rent, ["dwelling_type", "year"])
    one = windows.most_specific(pairs, keys)
    return one.select(
        "geospatial_codes",
        "dwelling_type",
        F.make_date("year", F.lit(12), F.lit(1)).alias("ds"),
        "annual_rent",
        "sale_price",
        (F.col("annual_rent") / F.col("sale_price")).alias("gross_yield"),
        F.lit("suburb_direct").alias("source"),
        F.lit(None).cast("string").alias("provenance_cluster_id"),
    ).select(*YIELD_COLUMNS)


def overall_rent(df: DataFrame, tier: str = "suburb", explode_groups: bool = False) -> DataFrame:
    """Mean annual rent of the all-dwelling, all-bedroom rows, per row key or per member."""
    rows = _rental_medians(df, tier).filter((F.col("dwelling_type") == "all") & (F.col("bedrooms") == "all"))
    if explode_groups:
        rows = rows.withColumn("geospatial_codes", F.explode(C.code_list("geospatial_codes")))
    return rows.groupBy("geospatial_codes").agg((F.avg("value") * WEEKS).alias("annual_rent"))


def cluster_rents(df: DataFrame, hierarchy: DataFrame, min_members: int = 3, explode_groups: bool = False) -> DataFrame:
    """E4. Median annual rent of each cluster with enough rented members."""
    rent = overall_rent(df, explode_groups=explode_groups)
    nodes = hierarchy.filter(F.col("tier") == "sal").select(
        F.col("node_id").alias("geospatial_codes"), "parent_cluster_id", "cluster_level"
    )
    med = aggs.cluster_median(
        nodes.join(rent, "geospatial_codes"), ["parent_cluster_id", "cluster_level"], "annual_rent", min_members
    )
    return med.withColumnRenamed("median_val", "cluster_annual_rent").withColumnRenamed("n_members", "n_rental_members")


def sales_orphans(df: DataFrame, direct: DataFrame) -> DataFrame:
    """D4. Observed sales of suburbs without a direct yield."""
    return joins.orphans(_observed_sales(df), direct.filter(F.col("source") == "suburb_direct"), ["geospatial_codes"])


def fallback_yields(
    df: DataFrame, direct: DataFrame, hierarchy: DataFrame, min_members: int = 3, explode_groups: bool = False
) -> DataFrame:
    """J14. Yield of an orphan suburb from the smallest cluster with enough rented members."""
    stats = cluster_rents(df, hierarchy, min_members, explode_groups)
    nodes = hierarchy.filter(F.col("tier") == "sal")
    orphans = sales_orphans(df, direct).select("geospatial_codes", "year", "sale_price")
    best = joins.smallest_cluster(orphans, nodes, stats)
    return best.select(
        "geospatial_codes",
        F.lit("all").alias("dwelling_type"),
        F.make_date("year", F.lit(12), F.lit(1)).alias("ds"),
        F.col("cluster_annual_rent").alias("annual_rent"),
        "sale_price",
        (F.col("cluster_annual_rent") / F.col("sale_price")).alias("gross_yield"),
        F.lit("cluster_fallback").alias("source"),
        F.col("parent_cluster_id").alias("provenance_cluster_id"),
    ).select(*YIELD_COLUMNS)


def borrowed_sales(df: DataFrame, yields: DataFrame, forecasts: DataFrame, today: date) -> DataFrame:
    """J15. Sale nowcast from a bedroom's latest annual rent and the suburb's latest yield.

    Each side is reduced to its latest row first, so the join is one row per series, not years x years.
    """
    rent = aggs.annual_mean(
        _rental_medians(df).filter(F.col("bedrooms") != "all"),
        ["geospatial_codes", "dwelling_type", "bedrooms"],
        factor=WEEKS,
        name="annual_rent",
    )
    newest = windows.latest_row(rent, ["geospatial_codes", "dwelling_type", "bedrooms"], "year")
    y = yields.groupBy("geospatial_codes", "dwelling_type").agg(F.max(F.struct("ds", "gross_yield")).alias("b")).select(
        "geospatial_codes", "dwelling_type", F.col("b.gross_yield").alias("gross_yield")
    )
    pairs = joins.containment_join(y, newest, ["dwelling_type"])
    one = windows.most_specific(pairs, ["geospatial_codes", "dwelling_type", "bedrooms"])
    none = F.lit(None).cast("double")
    rows = one.withColumns(
        {
            "geospatial_type": F.lit("suburb"),
            "data_type": F.lit("sales"),
            "ds": F.make_date("year", F.lit(12), F.lit(1)),
            "horizon_q": F.lit(0),
            "is_nowcast": F.lit(True),
            "cpi_is_projected": F.lit(False),
            "y_hat": F.col("annual_rent") / F.col("gross_yield"),
            "y_hat_lo_80": none, "y_hat_hi_80": none, "y_hat_lo_95": none, "y_hat_hi_95": none,
            "model": F.lit("bedroom_borrowed"),
            "fit_date": F.lit(today),
            "imputation_method": F.lit("nowcast_bedroom_borrowed"),
            "provenance_cluster_id": F.lit(None).cast("string"),
        }
    ).withColumn("series_id", C.series_id())
    return joins.gap_fill(rows, forecasts).select(*FORECAST_COLUMNS)


def corroborate(df: DataFrame, hierarchy: DataFrame, explode_groups: bool = False) -> DataFrame:
    """J16. Each parent region's rent beside the child-tier median at the deepest level."""
    parents = overall_rent(df, "lga").select(
        F.col("geospatial_codes").alias("lga_code"), F.col("annual_rent").alias("lga_rent")
    )
    child = overall_rent(df, explode_groups=explode_groups)
    nodes = hierarchy.filter(F.col("tier") == "sal").select(
        F.col("node_id").alias("geospatial_codes"), "cluster_level"
    )
    levels = windows.exact_median(nodes.join(child, "geospatial_codes"), ["cluster_level"], "annual_rent", "geospatial_codes", "median_val", "n_members")
    deepest = windows.top1(levels.select("cluster_level", "median_val"), "cluster_level")
    paired = joins.cross_scalar(parents, deepest)
    return paired.select(
        "lga_code",
        "lga_rent",
        F.col("cluster_level").alias("sal_cluster_level"),
        F.col("median_val").alias("sal_cluster_median_rent"),
        ((F.col("median_val") - F.col("lga_rent")) / F.col("lga_rent") * 100.0).alias("divergence_pct"),
    )
