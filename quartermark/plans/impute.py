"""2I: fill the missing cells of the region x market x dwelling x bedroom cube.

Classes run in the order A, C, B, D; each sees the rows of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import aggs, joins, windows
from quartermark.schemas import OBS_COLUMNS
from quartermark.session import cut
from quartermark.operators.sets import append_derived

REGION = ["geospatial", "geospatial_codes", "geospatial_type", "time_bucket"]


def _tag(df: DataFrame, source: str, sheet: str) -> DataFrame:
    return df.withColumns(
        {
            "source_file": F.lit(source),
            "source_sheet": F.lit(sheet),
            "cell": F.lit(""),
        }
    ).select(*OBS_COLUMNS)


def _rental(working: DataFrame, statistic: str) -> DataFrame:
    return working.filter(
        (F.col("data_type") == "rental")
        & (F.col("geospatial_type") == "suburb")
        & (F.col("statistic") == statistic)
        & F.col("dwelling_type").isin("unit", "house")
        & F.col("value").isNotNull()
    )


def _sales_all(working: DataFrame) -> DataFrame:
    return working.filter(
        (F.col("data_type") == "sales")
        & (F.col("geospatial_type") == "suburb")
        & (F.col("statistic") == "median")
        & F.col("dwelling_type").isin("unit", "house")
        & (F.col("bedrooms") == "all")
        & F.col("value").isNotNull()
    ).select(*REGION, "dwelling_type", "value", F.year("time_bucket").alias("year"))


def impute_a(obs: DataFrame) -> DataFrame:
    """I1. Rental per-dwelling roll-up over bedrooms: a median and a count row per cell."""
    child = obs.filter(
        (F.col("data_type") == "rental")
        & F.col("dwelling_type").isin("unit", "house")
        & ~F.col("bedrooms").isin("all", "0")
    )
    keys = [*REGION, "dwelling_type", "data_frequency"]
    pairs = aggs.paired_stats(child, [*keys, "bedrooms"])
    rolled = aggs.weighted_rollup(pairs, keys, "median_val", "count_val")
    both = F.array(
        F.struct(F.lit("median").alias("statistic"), F.col("value").alias("v")),
        F.struct(F.lit("count").alias("statistic"), F.col("weight").alias("v")),
    )
    rows = rolled.withColumn("s", F.explode(both)).select(
        *keys,
        F.col("s.statistic").alias("statistic"),
        F.col("s.v").alias("value"),
        F.lit("all").alias("bedrooms"),
        F.concat("dwelling_type", F.lit("-all")).alias("dwelling_class"),
        F.lit("rental").alias("data_type"),
    )
    return _tag(rows, "imputed:rollup_rental_dwelling_all", "class_a")


def impute_c(working: DataFrame) -> DataFrame:
    """I2. Sales all-dwelling roll-up, weighted by the rented stock; weight 1 where unknown."""
    weights = aggs.annual_mean(
        _rental(working, "count").filter(F.col("bedrooms") == "all"),
        ["geospatial_codes", "dwelling_type"],
        name="w",
    )
    sales = _sales_all(working).withColumnRenamed("value", "sale_price")
    matched = joins.containment_join(sales, weights, ["dwelling_type", "year"], "left")
    one = windows.most_specific(matched, [*REGION, "dwelling_type", "sale_price"])
    one = one.withColumn("w", F.coalesce("w", F.lit(1.0)))
    rows = aggs.weighted_rollup(one, REGION, "sale_price", "w").select(
        *REGION,
        "value",
        F.lit("all").alias("dwelling_type"),
        F.lit("all").alias("bedrooms"),
        F.lit("all").alias("dwelling_class"),
        F.lit("median").alias("statistic"),
        F.lit("sales").alias("data_type"),
        F.lit("annual").alias("data_frequency"),
    )
    return _tag(rows, "imputed:rollup_sales_dwelling_all", "class_c")


def bedroom_ratios(working: DataFrame) -> DataFrame:
    """D1. Per-bedroom rent over the dwelling's overall rent, by group and year."""
    medians = _rental(working, "median")
    keys = ["geospatial_codes", "dwelling_type"]
    per_bed = aggs.annual_mean(
        medians.filter(~F.col("bedrooms").isin("all", "0")), [*keys, "bedrooms"], name="rent_bedroom"
    )
    overall = aggs.annual_mean(medians.filter(F.col("bedrooms") == "all"), keys, name="rent_all")
    return (
        per_bed.join(overall.filter(F.col("rent_all") > 0), [*keys, "year"])
        .withColumn("ratio", F.col("rent_bedroom") / F.col("rent_all"))
        .select(*keys, "bedrooms", "year", "ratio")
    )


def impute_b(working: DataFrame) -> DataFrame:
    """I3. Sales per bedroom: the dwelling price times the rental ratio of the bedroom."""
    matched = joins.containment_join(_sales_all(working), bedroom_ratios(working), ["dwelling_type", "year"])
    one = windows.most_specific(matched, [*REGION, "dwelling_type", "bedrooms"])
    rows = one.select(
        *REGION,
        "dwelling_type",
        "bedrooms",
        (F.col("value") * F.col("ratio")).alias("value"),
        F.concat_ws("-", "dwelling_type", "bedrooms").alias("dwelling_class"),
        F.lit("median").alias("statistic"),
        F.lit("sales").alias("data_type"),
        F.lit("annual").alias("data_frequency"),
    )
    return _tag(rows, "imputed:disagg_sales_bedroom", "class_b")


def impute_d(working: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """I4. Sales rolled up to the parent tier: plain mean over the member suburbs."""
    sales = working.filter(
        (F.col("data_type") == "sales")
        & (F.col("geospatial_type") == "suburb")
        & (F.col("statistic") == "median")
        & F.col("value").isNotNull()
    )
    joined = sales.join(crosswalk, F.col("geospatial_codes") == F.col("sal_code"))
    rolled = joined.groupBy("lga_code", "lga_name", "time_bucket", "dwelling_type", "bedrooms").agg(
        F.avg("value").alias("value"), F.min("dwelling_class").alias("dwelling_class")
    )
    rows = rolled.select(
        F.col("lga_name").alias("geospatial"),
        F.col("lga_code").alias("geospatial_codes"),
        F.lit("lga").alias("geospatial_type"),
        "time_bucket",
        "dwelling_type",
        "bedrooms",
        "dwelling_class",
        F.lit("median").alias("statistic"),
        "value",
        F.lit("sales").alias("data_type"),
        F.lit("annual").alias("data_frequency"),
    )
    return _tag(rows, "imputed:rollup_sales_lga", "class_d")


def strip_derived(df: DataFrame) -> DataFrame:
    """B5. Rows that no earlier run produced."""
    return df.filter(~C.is_imputed())


def first_class(rows: DataFrame) -> DataFrame:
    """Observed rows with class A behind them. Only class A is written: `rows` should be a written table already."""
    obs = strip_derived(rows)
    return append_derived(obs, cut(impute_a(obs)))


def later_classes(first: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """`first_class` with classes C, B and D behind it; C and B, which D reads, are written."""
    c = impute_c(first)
    second = append_derived(first, cut(append_derived(c, impute_b(first))))
    return append_derived(second, impute_d(second, crosswalk))


def impute(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """I5. The whole job: strip, recompute, append. Running it on its own output changes nothing.

    `rows` is read by every class; each class' own rows are written, the observed ones are not copied.
    """
    return later_classes(first_class(rows), crosswalk)
