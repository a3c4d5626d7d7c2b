"""2M: data-quality operators and the lineage classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.operators import windows
from quartermark.operators.sets import PAIRS
from quartermark.schemas import BANDS, CLUSTER_METHODS, DIRECT_METHODS

# Lineage patterns.
P1 = "P1_VENDOR_GAP"
P2 = "P2_OBSERVED_NOT_REIMPUTED"
P3 = "P3_BELOW_SARIMAX_MIN_OBS"
P4 = "P4_CROSS_TIER_IMPUTE_EXPANSION"
P5 = "P5_MULTI_SAL_GROUP_EDGE_CASE"
P6 = "P6_UNCLASSIFIED"
SMALL_DIFF = 2

# Highest accepted median error per market.
THRESHOLDS = {"rental": 0.15, "sales": 0.20}


def quality_gate(diag: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """M1. Median error per market beside its threshold; markets without rows are absent."""
    market = F.split_part(F.col("series_id"), F.lit("|"), F.lit(1))
    limit = F.lit(None).cast("double")
    for name, value in thresholds.items():
        limit = F.when(F.col("data_type") == name, F.lit(value)).otherwise(limit)
    rows = diag.filter(F.col("smape").isNotNull()).select(market.alias("data_type"), "series_id", "smape")
    med = windows.exact_median(rows, ["data_type"], "smape", "series_id", "median_smape", "n_series")
    gated = med.withColumn("threshold", limit).filter(F.col("threshold").isNotNull())
    return gated.withColumn("breach", F.col("median_smape") > F.col("threshold"))


def band_violation():
    """NULL bounds pass (borrowed rows have none); NaN or an inversion does not."""
    pairs = zip(BANDS, BANDS[1:])
    nan = reduce(lambda a, b: a | b, [F.isnan(c) for c in BANDS])
    down = reduce(lambda a, b: a | b, [F.col(a) > F.col(b) for a, b in pairs])
    return F.coalesce(nan | down, F.lit(False))


def check_bands(fc: DataFrame) -> DataFrame:
    """M2. Rows and ordering violations per model."""
    return fc.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(band_violation()).alias("n_violations")
    )


def check_provenance(fc: DataFrame) -> DataFrame:
    """M3. A cluster id is present exactly for the cluster methods."""
    m, c = F.col("imputation_method"), F.col("provenance_cluster_id")
    return fc.agg(
        F.count_if(m.isin(DIRECT_METHODS) & c.isNotNull()).alias("direct_with_cluster"),
        F.count_if(m.isin(CLUSTER_METHODS) & c.isNull()).alias("cluster_without_id"),
    )


def require_clean(report: DataFrame, columns: list[str]) -> None:
    """Raise when any counter of a check is not zero; reads one aggregate row."""
    row = report.agg(*[F.sum(c).alias(c) for c in columns]).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise ValueError(f"check failed: {bad}")


def check_schema(df: DataFrame, schema: T.StructType, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """M4. One row per column: present, type, NULLs where none are allowed, values off the list."""
    have = {f.name: f.dataType for f in df.schema}
    counters = []
    for f in schema:
        if f.name not in have:
            continue
        c = F.col(f.name)
        nulls = F.count_if(c.isNull()) if not f.nullable else F.lit(0).cast("long")
        allowed = (enums or {}).get(f.name)
        off = F.count_if(~c.isin(allowed)) if allowed else F.lit(0).cast("long")
        counters.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(have[f.name] == f.dataType).alias("type_ok"),
                nulls.alias("n_null"),
                off.alias("n_off_list"),
            )
        )
    absent = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(False).alias("type_ok"),
            F.lit(None).cast("long").alias("n_null"),
            F.lit(None).cast("long").alias("n_off_list"),
        )
        for f in schema
        if f.name not in have
    ]
    return df.agg(F.array(*counters, *absent).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def classify_diffs(presence: DataFrame, diffs: DataFrame) -> DataFrame:
    """M5. One row per (slice, pair) with the number of polygons and the pattern behind it."""
    dims = ["tier", "dwelling_type", "bedrooms"]
    sizes = presence.groupBy(*dims).agg(
        F.count_if("obs").alias("n_obs"), F.count_if("imp").alias("n_imp"), F.count_if("fc").alias("n_fc")
    )
    counted = diffs.groupBy(*dims, "pair_order", "pair").agg(F.count(F.lit(1)).alias("n_diff"))
    return classify_counts(counted, sizes)


def classify_counts(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """M5 from (slice, pair, n_diff) and the class sizes of each slice, however they were counted."""
    dims = ["tier", "dwelling_type", "bedrooms"]
    small = F.col("n_diff") <= SMALL_DIFF
    pattern = (
        F.when(
            F.col("pair") == "imp_minus_obs",
            F.when(F.col("n_obs") == 0, P1).when(small, P5).otherwise(P4),
        )
        .when(F.col("pair") == "obs_minus_imp", F.when(small, P5).otherwise(P2))
        .when(F.col("pair").isin("obs_minus_fc", "imp_minus_fc"), F.when(small, P5).otherwise(P3))
        .when(
            F.col("pair").isin("fc_minus_obs", "fc_minus_imp"),
            F.when((F.col("n_obs") == 0) | (F.col("n_imp") == 0), P1).when(small, P5).otherwise(P4),
        )
        .otherwise(P6)
    )
    return counted.join(sizes, dims).withColumn("pattern", pattern)


def lineage_rollup(classified: DataFrame, diffs: DataFrame, k: int = 5) -> DataFrame:
    """E18. Per pattern: slices, appearances, distinct polygons and the k largest examples."""
    example = F.struct(
        (-F.col("n_diff")).alias("neg"), "dwelling_type", "bedrooms", "pair", F.col("n_diff").alias("count")
    )
    # Classified rows number slices x pairs (at most 9 x 2 x 6), so the example list is bounded.
    heads = classified.groupBy("pattern").agg(
        F.countDistinct("tier", "dwelling_type", "bedrooms").alias("slices_affected"),
        F.sum("n_diff").alias("appearances"),
        F.slice(F.array_sort(F.collect_list(example)), 1, k).alias("examples"),
    )
    tagged = diffs.join(
        F.broadcast(classified.select("tier", "dwelling_type", "bedrooms", "pair", "pattern")),
        ["tier", "dwelling_type", "bedrooms", "pair"],
    )
    polygons = tagged.select("pattern", "polygon").distinct().groupBy("pattern").agg(
        F.count(F.lit(1)).alias("unique_polygons")
    )
    return heads.join(polygons, "pattern").orderBy(F.col("slices_affected").desc(), "pattern")


def pattern_polygons(classified: DataFrame, diffs: DataFrame) -> DataFrame:
    """E18. The distinct polygons of each pattern as rows, so the set is never one value."""
    dims = ["tier", "dwelling_type", "bedrooms", "pair"]
    return diffs.join(F.broadcast(classified.select(*dims, "pattern")), dims).select("pattern", "polygon").distinct()


def absence_reason(classified: DataFrame) -> DataFrame:
    """M6. Per slice and cohort: the pattern of the first pair that lists what the cohort lacks."""
    lacking = {n: b for n, _, b in PAIRS}
    cohort = F.lit(None).cast("string")
    for pair, b in lacking.items():
        cohort = F.when(F.col("pair") == pair, F.lit(b)).otherwise(cohort)
    return classified.groupBy("tier", "dwelling_type", "bedrooms", cohort.alias("cohort")).agg(
        F.min_by("pattern", "pair_order").alias("reason")
    )


def yield_envelope(yields: DataFrame, lo: float = 0.01, hi: float = 0.20) -> DataFrame:
    """M7. Yields inside and outside the plausible band, per source."""
    inside = F.col("gross_yield").between(lo, hi)
    return yields.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_yields"), F.count_if(~inside).alias("n_outside")
    )


