"""2E: aggregations. Top-1 picks use min_by/max_by so they combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import medians
from quartermark.schemas import SLICES

EVENT_KEYS = ["data_type", "dwelling_type", "bedrooms"]


def paired_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """E1. Median and count side by side; keys lacking either, or with count 0, drop out."""
    med = F.max(F.when(F.col("statistic") == "median", F.col("value")))
    cnt = F.max(F.when(F.col("statistic") == "count", F.col("value")))
    both = df.groupBy(*keys).agg(med.alias("median_val"), cnt.alias("count_val"))
    return both.filter(F.col("median_val").isNotNull() & (F.col("count_val") > 0))


def weighted_rollup(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """E2."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col(weight)) / total).alias("value"), total.alias("weight")
    )


def annual_mean(df: DataFrame, keys: list[str], factor: float = 1.0, name: str = "value") -> DataFrame:
    """E3. Mean by calendar year, times 52 for an annual rent from weekly figures."""
    mean = F.avg("value")
    mean = mean * factor if factor != 1.0 else mean
    return (
        df.filter(F.col("value").isNotNull())
        .groupBy(*keys, F.year("time_bucket").alias("year"))
        .agg(mean.alias(name))
    )


def cluster_median(
    df: DataFrame, keys: list[str], value: str, min_n: int, accuracy: int | None = None
) -> DataFrame:
    """E4. Median per group with a least number of members: exact, or by a mergeable sketch of that `accuracy`."""
    if accuracy is None:
        out = medians.median(df, keys, value)
    else:
        sketch = F.percentile_approx(value, 0.5, accuracy)
        out = df.groupBy(*keys).agg(sketch.alias("median_val"), F.count(F.lit(1)).alias("n_members"))
    return out.filter(F.col("n_members") >= min_n)


def latest(df: DataFrame, keys: list[str], value: str = "value", ts: str = "time_bucket") -> DataFrame:
    """E5. Value at the latest date, and the date; equal dates resolve to the larger value."""
    best = F.max(F.struct(ts, value))
    return df.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col(f"__b.{value}").alias("value"), F.col(f"__b.{ts}").alias("date")
    )


def group_labels(df: DataFrame, market: str) -> DataFrame:
    """E6. One label per group code list of a market: the least one."""
    rows = df.filter(
        (F.col("geospatial_type") == "suburb")
        & (F.col("statistic") == "median")
        & (F.col("data_type") == market)
        & (F.col("geospatial_codes") != "")
    )
    return rows.groupBy("geospatial_codes").agg(F.min("geospatial").alias("label"))


def source_class(df: DataFrame) -> DataFrame:
    """E7. `observed` once any row is, otherwise the imputation source."""
    flagged = df.filter(F.col("statistic") == "median")
    agg = flagged.groupBy(C.series_id().alias("series_id")).agg(
        F.bool_and(C.is_imputed()).alias("__all"),
        F.max(F.when(C.is_imputed(), F.col("source_file"))).alias("__src"),
    )
    return agg.select(
        "series_id", F.when(F.col("__all"), F.col("__src")).otherwise("observed").alias("source_class")
    )


def to_series(df: DataFrame, keys: list[str], ts: str = "time_bucket", value: str = "value") -> DataFrame:
    """E8. One row per series with its points in date order.

    A series holds at most one point per calendar bucket, so the collected array is bounded by the
    calendar; where a source repeats a bucket the points are first reduced to one per bucket.
    """
    per_bucket = df.groupBy(*keys, ts).agg(
        F.max(value).alias("__v"), F.bool_and(C.is_imputed()).alias("__i")
    )
    return per_bucket.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col("__v").alias("value")))).alias("points"),
        F.bool_and("__i").alias("imputed"),
    )


def forecast_series(fc: DataFrame, keys: list[str]) -> DataFrame:
    """E12. Forecast rows folded to ordered points; the horizon bounds the array."""
    point = F.struct(
        F.col("ds").alias("ts"),
        F.col("y_hat"),
        F.col("y_hat_lo_80").alias("lo80"),
        F.col("y_hat_hi_80").alias("hi80"),
        F.col("y_hat_lo_95").alias("lo95"),
        F.col("y_hat_hi_95").alias("hi95"),
        F.col("imputation_method"),
        F.col("is_nowcast"),
    )
    return fc.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("forecast"))


def coverage(obs: DataFrame, forecasts: DataFrame, approximate: bool = False) -> DataFrame:
    """E9. Distinct polygons, and distinct row keys, per tier, slice and source class."""
    dims = ["geospatial_type", "dwelling_type", "bedrooms"]
    rows = obs.filter(F.col("statistic") == "median").select(
        *dims, "geospatial_codes", C.source_class().alias("source_class")
    )
    fc = forecasts.select(*dims, "geospatial_codes", F.lit("forecast").alias("source_class"))
    valid = rows.unionByName(fc).filter((F.col("dwelling_type") != "vacant_land") & (F.col("bedrooms") != "0"))
    keys = valid.distinct().withColumn("polygon", F.explode(C.code_list("geospatial_codes")))
    by = [C.tier_of().alias("tier"), "dwelling_type", "bedrooms", "source_class"]
    if approximate:
        regions, groups = F.approx_count_distinct("polygon", 0.01), F.approx_count_distinct("geospatial_codes", 0.01)
    else:
        regions, groups = F.countDistinct("polygon"), F.countDistinct("geospatial_codes")
    return (
        keys.groupBy(*by)
        .agg(regions.alias("region_count"), groups.alias("row_key_count"))
        .filter(F.col("tier").isNotNull())
    )


def value_domain(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """E10."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(value), F.lit(0.0)).alias("value_min"),
        F.coalesce(F.max(value), F.lit(1.0)).alias("value_max"),
    )


def series_extent(df: DataFrame, key: str = "unique_id", ts: str = "ds") -> DataFrame:
    """E11."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_obs"), F.max(ts).alias("last_ds"))


def coverage_pivot(cov: DataFrame) -> DataFrame:
    """E13. Observed, imputed and forecast counts as columns, zero-filled, in slice order."""
    wide = (
        cov.groupBy("tier", "dwelling_type", "bedrooms")
        .pivot("source_class", ["observed", "imputed", "forecast"])
        .sum("region_count")
        .fillna(0, ["observed", "imputed", "forecast"])
    )
    return wide.orderBy("tier", *C.slice_order())


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """E14. First row per key in a total order, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [c for c in order if c not in keys] + [c for c in rest if c not in order]
    first = F.min(F.struct(*ranked)).alias("__r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def coverage_matrix(obs: DataFrame) -> DataFrame:
    """E15. Every possible cell of the cube with its observed and imputed polygon counts.

    Axes are program literals (36 cells); the counts come from one pass over the rows.
    """
    spark = obs.sparkSession
    axes = [
        (market, tier, d, b)
        for market in ("rental", "sales")
        for tier in ("lga", "suburb")
        for d, b in SLICES
    ]
    cells = spark.createDataFrame(axes, "data_type string, geospatial_type string, dwelling_type string, bedrooms string")
    dims = ["data_type", "geospatial_type", "dwelling_type", "bedrooms"]
    keys = (
        obs.filter(F.col("statistic") == "median")
        .select(*dims, "geospatial_codes", C.is_imputed().alias("imp"))
        .distinct()
        .withColumn("polygon", F.explode(C.code_list("geospatial_codes")))
    )
    counts = keys.groupBy(*dims).agg(
        F.countDistinct(F.when(~F.col("imp"), F.col("polygon"))).alias("observed"),
        F.countDistinct(F.when(F.col("imp"), F.col("polygon"))).alias("imputed"),
    )
    return cells.join(counts, dims, "left").fillna(0, ["observed", "imputed"])


def mapping_summary(mapping: DataFrame, orphan_codes: DataFrame) -> DataFrame:
    """E16. Universe counts in one pass over the mapping."""
    r, s = F.col("rental"), F.col("sales")
    multi = lambda c: F.countDistinct(F.when(F.col(f"{c}.group_size") > 1, F.col(f"{c}.group_codes")))
    main = mapping.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(r.isNotNull()).alias("with_rental"),
        F.count_if(s.isNotNull()).alias("with_sales"),
        F.countDistinct("rental.group_codes").alias("rental_groups"),
        F.countDistinct("sales.group_codes").alias("sales_groups"),
        multi("rental").alias("rental_groups_multi"),
        multi("sales").alias("sales_groups_multi"),
        F.count_if(r.isNull() & s.isNull()).alias("no_data"),
    )
    return main.withColumn("orphan_codes", orphan_codes.agg(F.count(F.lit(1))).scalar())


def region_totals(regions: DataFrame, observed: DataFrame) -> DataFrame:
    """E16. Per tier: polygons in all and polygons with observed rows."""
    total = regions.groupBy("tier").agg(F.countDistinct("code").alias("total"))
    seen = observed.groupBy("tier").agg(F.countDistinct("code").alias("observed"))
    return (
        total.join(seen, "tier", "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .withColumn("imputed_target", F.col("observed"))
    )


def symmetric_error(actual: Column, predicted: Column) -> Column:
    """|a-p| over the mean magnitude; NULL when both are zero."""
    size = (F.abs(actual) + F.abs(predicted)) / 2
    return F.abs(actual - predicted) / F.when(size != 0, size)


def smape(fc: DataFrame, actual: DataFrame, key: str = "unique_id") -> DataFrame:
    """E17."""
    both = fc.select(key, "ds", "y_hat").join(actual.select(key, "ds", "y"), [key, "ds"])
    return both.groupBy(key).agg(
        F.avg(symmetric_error(F.col("y"), F.col("y_hat"))).alias("smape"), F.count(F.lit(1)).alias("n_scored")
    )


def cluster_stats(assign: DataFrame, nodes: DataFrame) -> DataFrame:
    """E19. Members, mean position, area and rented members per cluster."""
    joined = assign.join(nodes, "node_id")
    return joined.groupBy(F.col("parent_cluster_id").alias("cluster_id"), "tier", "cluster_level").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.avg("lat").alias("centroid_lat"),
        F.avg("lon").alias("centroid_lon"),
        F.sum("area_km2").alias("area_km2"),
        F.count_if("has_rental").alias("n_nodes_with_rental"),
    )


def collisions(groups: DataFrame) -> DataFrame:
    """E21. Codes that sit in more than one group."""
    codes = groups.select("geospatial_codes", F.explode(C.code_list("geospatial_codes")).alias("code"))
    return (
        codes.groupBy("code")
        .agg(F.countDistinct("geospatial_codes").alias("n_groups"))
        .filter(F.col("n_groups") > 1)
    )


def observed_codes(df: DataFrame) -> DataFrame:
    """E22. Polygons of each tier with at least one observed median row, ordered."""
    rows = df.filter((F.col("statistic") == "median") & ~C.is_imputed() & (F.col("geospatial_codes") != ""))
    keys = rows.select(C.tier_of().alias("tier"), "geospatial_codes").distinct()
    return keys.select("tier", F.explode(C.code_list("geospatial_codes")).alias("code")).distinct().orderBy("tier", "code")


def codes_with_data(df: DataFrame) -> DataFrame:
    """E23. Polygons present at all, trimmed, blanks removed."""
    keys = df.select(C.tier_of().alias("tier"), "geospatial_codes").distinct()
    codes = F.transform(C.code_list("geospatial_codes"), lambda c: F.trim(c))
    return keys.select("tier", F.explode(codes).alias("code")).filter(F.col("code") != "").distinct()


def latest_by_polygon(df: DataFrame, keys: list[str]) -> DataFrame:
    """E24. Latest value of a group handed to each member: later date, then shorter group, then code."""
    per_group = latest(df, [*keys, "geospatial_codes"])
    members = per_group.withColumn("code", F.explode(C.code_list("geospatial_codes")))
    rank = F.struct(
        F.col("date"), (-F.length("geospatial_codes")).alias("short"), F.col("geospatial_codes"), F.col("value")
    )
    return members.groupBy(*keys, "code").agg(F.max(rank).alias("b")).select(
        *keys, "code", F.col("b.value").alias("value"), F.col("b.date").alias("date")
    )
