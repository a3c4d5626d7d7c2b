"""2D: joins. Broadcast is left to the size check of spark.sql.autoBroadcastJoinThreshold and AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermark.functions import columns as C


def left_default(a: DataFrame, b: DataFrame, on: list[str], column: str, default: object) -> DataFrame:
    """D2. Left join; a missing right value becomes `default`."""
    right = b.select(*on, F.col(column).alias("__v"))
    return a.join(right, on, "left").withColumn(column, F.coalesce("__v", F.lit(default))).drop("__v")


def containment_join(
    single: DataFrame,
    grouped: DataFrame,
    on: list[str],
    how: str = "inner",
    codes: str = "geospatial_codes",
    group_alias: str = "group_codes",
) -> DataFrame:
    """D3. Pair each row of `single` with the rows of `grouped` whose code list holds its code.

    The list side is exploded, so the join is an equi-join on the (many-valued) code and the
    side keys instead of a pattern match inside a few large (dwelling, year) groups. A probe that
    is itself a run of codes joins on its first code and is checked by the residual predicate.
    """
    right = grouped.withColumnRenamed(codes, group_alias).withColumn(
        "__code", F.explode(C.code_list(group_alias))
    )
    left = single.withColumn("__code", F.split_part(F.col(codes), F.lit("-"), F.lit(1)))
    residual = C.has_code("r." + group_alias, F.col("l." + codes))
    keys = ["__code", *on]
    cond: Column = residual
    for k in keys:
        cond = cond & (F.col("l." + k) == F.col("r." + k))
    joined = left.alias("l").join(right.alias("r"), cond, how)
    extra = [F.col("r." + c) for c in right.columns if c not in [*keys, *single.columns]]
    return joined.select(*[F.col("l." + c) for c in single.columns], *extra)


def orphans(sales: DataFrame, yields: DataFrame, on: list[str]) -> DataFrame:
    """D4. Rows with no partner."""
    return sales.join(yields.select(*on), on, "left_anti")


def gap_fill(candidates: DataFrame, existing: DataFrame, key: str = "series_id") -> DataFrame:
    """D5. Candidates whose key is not there yet."""
    return candidates.join(existing.select(key), key, "left_anti")


def restrict(df: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """D6, K15. Rows whose key is in the key set."""
    on = [on] if isinstance(on, str) else on
    return df.join(keys.select(*on), on, "left_semi")


def cross_values(df: DataFrame, column: str, values: list[object]) -> DataFrame:
    """D7. Every row once per literal value, as a generator rather than a join."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def cross_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """D7. Attach the columns of a one-row table, as a scalar subquery: evaluated once, no join."""
    row = one_row.limit(1).select(F.struct("*")).scalar()
    return df.withColumn("__row", row).filter(F.col("__row").isNotNull()).select(*df.columns, "__row.*")


def align_annual(quarterly: DataFrame, annual: DataFrame, keys: list[str]) -> DataFrame:
    """D11. Last quarter of each year beside that year's annual value."""
    last = quarterly.groupBy(*keys, F.year("ts").alias("__y")).agg(F.max_by("value", "ts").alias("rental_weekly"))
    yearly = annual.withColumn("__y", F.year("ts")).withColumnRenamed("value", "sale_price")
    return yearly.join(last, [*keys, "__y"]).select(*keys, "ts", "rental_weekly", "sale_price")


def with_exog(series: DataFrame, index: DataFrame) -> DataFrame:
    """D12. Inner join on the date. Annual rows sit on dates the quarterly index lacks and drop out.

    The index is that of one region: a date that occurs twice fails the job rather than doubling rows.
    """
    twice = F.raise_error(F.lit("the index has several rows for one date; pass one region")).cast("double")
    right = index.filter(F.col("index_value").isNotNull()).groupBy(F.col("time_bucket").alias("ds")).agg(
        F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max("index_value")).alias("cpi")
    )
    return series.filter(F.col("y").isNotNull()).join(right, "ds")


def attach_forecast(series: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """D13. Folded forecasts beside folded observations."""
    return series.join(forecast, keys, "left")


def cell_values(cells: DataFrame, latest: DataFrame, names: DataFrame, lo: float | None, hi: float | None) -> DataFrame:
    """D14. Map cell, region, latest value and name; the range filter runs before the fan-out."""
    wanted = latest if lo is None else latest.filter(F.col("value").between(lo, hi))
    named = wanted.join(names, "code", "left").withColumn("name", F.coalesce("name", "code"))
    return cells.join(named, "code")


def resolve_codes(df: DataFrame, lookup: DataFrame, remap: dict[str, str], label: str = "geospatial") -> DataFrame:
    """D15. Grouped names to `-`-joined codes, unresolved parts skipped, rows without any dropped.

    Only the distinct labels are split and joined, so a label that fills a third of the rows costs
    one lookup.
    """
    name = F.lower(label)
    fixed = F.lit(None).cast("string")
    for raw, target in remap.items():
        fixed = F.when(name == raw, F.lit(target)).otherwise(fixed)
    parts = F.filter(
        F.transform(F.split(name, "-"), lambda p: F.trim(p)), lambda p: p != ""
    )
    keys = F.when(fixed.isNotNull(), F.array(fixed)).otherwise(parts)
    labels = df.select(label).distinct().select(label, F.posexplode(keys).alias("__pos", "__name"))
    codes = (
        labels.join(lookup.select(F.col("name").alias("__name"), "code"), "__name")
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("__pos", "code"))).alias("__c"))
        .select(label, F.array_join(F.col("__c.code"), "-").alias("geospatial_codes"))
    )
    return df.join(codes, label)


def future_exog(last: DataFrame, index: DataFrame, h: int, months: int = 3) -> DataFrame:
    """D16. The first `h` index rows after each series' own last date.

    The index lies on a regular grid, so each distinct last date expands to its own future dates
    and meets the index by equality: no range join, and the work follows the number of dates.
    """
    grid = F.explode(F.sequence(F.lit(1), F.lit(h + 1)))
    ends = last.select("last_ds").distinct()
    ahead = ends.withColumn("__k", grid).withColumn("ds", F.add_months("last_ds", F.col("__k") * months))
    hits = ahead.join(index.select(F.col("time_bucket").alias("ds"), F.col("index_value").alias("cpi")), "ds")
    return last.join(hits.filter(F.col("__k") <= h).select("last_ds", "ds", "cpi"), "last_ds").select(
        "series_id", "ds", "cpi"
    )


def presence(obs: DataFrame, forecasts: DataFrame) -> DataFrame:
    """D17. One row per (tier, slice, polygon) with observed / imputed / forecast flags."""
    dims = ["geospatial_type", "dwelling_type", "bedrooms"]
    a = obs.filter(F.col("statistic") == "median").select(
        *dims, "geospatial_codes", C.source_class().alias("cls")
    )
    b = forecasts.select(*dims, "geospatial_codes", F.lit("forecast").alias("cls"))
    rows = a.unionByName(b).filter((F.col("dwelling_type") != "vacant_land") & (F.col("bedrooms") != "0"))
    # Row keys repeat once per date: collapse them before the codes fan out.
    keys = rows.groupBy(*dims, "geospatial_codes").agg(
        F.bool_or(F.col("cls") == "observed").alias("obs"),
        F.bool_or(F.col("cls") == "imputed").alias("imp"),
        F.bool_or(F.col("cls") == "forecast").alias("fc"),
    )
    polygons = keys.withColumn("polygon", F.explode(C.code_list("geospatial_codes")))
    return (
        polygons.groupBy(C.tier_of().alias("tier"), "dwelling_type", "bedrooms", "polygon")
        .agg(F.bool_or("obs").alias("obs"), F.bool_or("imp").alias("imp"), F.bool_or("fc").alias("fc"))
        .filter(F.col("tier").isNotNull())
    )


def smallest_cluster(orphan: DataFrame, hierarchy: DataFrame, stats: DataFrame) -> DataFrame:
    """D18, F3. Deepest qualifying cluster of each orphan; ties resolved by year and price."""
    levels = orphan.join(
        hierarchy.select(F.col("node_id").alias("geospatial_codes"), "parent_cluster_id", "cluster_level"),
        "geospatial_codes",
    ).join(stats, ["parent_cluster_id", "cluster_level"])
    best = F.struct("cluster_level", "year", "sale_price", "parent_cluster_id", "cluster_annual_rent")
    return levels.groupBy("geospatial_codes").agg(F.max(best).alias("b")).select("geospatial_codes", "b.*")


def region_mapping(regions: DataFrame, rental: DataFrame, sales: DataFrame) -> DataFrame:
    """D19. Each region with its rental group and its sales group, or NULL."""

    def members(groups: DataFrame, name: str) -> DataFrame:
        size = F.size(F.split("geospatial_codes", "-"))
        entry = F.struct(
            F.col("geospatial_codes").alias("group_codes"),
            F.col("label").alias("group_label"),
            size.alias("group_size"),
        )
        exploded = groups.select(F.explode(C.code_list("geospatial_codes")).alias("code"), entry.alias("e"))
        return exploded.groupBy("code").agg(F.min("e").alias(name))

    return regions.join(members(rental, "rental"), "code", "left").join(members(sales, "sales"), "code", "left")
