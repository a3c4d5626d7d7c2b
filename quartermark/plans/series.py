"""2J without the model: long frames, horizons, annotation, bands, yield series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import joins
from quartermark.operators.quality import band_violation
from quartermark.schemas import BANDS, FORECAST_COLUMNS, MODEL_COLUMNS, SERIES_DIMS, Z_80, Z_95

STALE_QUARTERS = 16
STALE_YEARS = 4
MIN_ANNUAL = 4
FORECAST_TARGET = date(2026, 12, 31)


def long_frame(df: DataFrame) -> DataFrame:
    """J1. (unique_id, ds, y) of every median row."""
    return df.filter((F.col("statistic") == "median") & F.col("value").isNotNull()).select(
        C.series_id().alias("unique_id"), F.col("time_bucket").alias("ds"), F.col("value").cast("double").alias("y")
    )


def infer_grid(df: DataFrame, ds: str = "ds") -> DataFrame:
    """J2. Quarter grid whose months cover the data: Mar/Jun/Sep/Dec, Feb/May/Aug/Nov, else plain."""
    months = F.collect_set(F.month(ds))
    inside = lambda allowed: F.size(F.array_except("m", F.array(*[F.lit(i) for i in allowed]))) == 0
    return df.agg(months.alias("m")).select(
        F.when(inside([3, 6, 9, 12]), "QS-DEC").when(inside([2, 5, 8, 11]), "QS-NOV").otherwise("QS").alias("grid")
    )


def carry_forward(index: DataFrame, h: int, months: int = 3) -> DataFrame:
    """J3. The index continued for h periods at its last value, per region."""
    last = index.groupBy("region").agg(
        F.max("time_bucket").alias("d"), F.max_by("index_value", "time_bucket").alias("index_value")
    )
    ahead = last.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h)))) if h > 0 else None
    if ahead is None:
        return index
    pad = ahead.select(
        "region", F.add_months("d", F.col("k") * months).alias("time_bucket"), "index_value"
    )
    return index.select("region", "time_bucket", "index_value").unionByName(pad)


def quarters_to(today: date, last: str = "last_ds") -> Column:
    now = today.year * 4 + (today.month - 1) // 3
    return F.greatest(F.lit(0), F.lit(now) - C.quarter_ordinal(last)).cast("int")


def years_to(year: int, last: str = "last_ds") -> Column:
    return F.greatest(F.lit(0), F.lit(year) - F.year(last)).cast("int")


def _ends(df: DataFrame) -> DataFrame:
    return df.groupBy("unique_id").agg(F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n_obs"))


def nowcast_h(df: DataFrame, today: date) -> DataFrame:
    """J4. Quarters from each series' last row to today, never negative."""
    return _ends(df).withColumn("h", quarters_to(today))


def annual_h(df: DataFrame, target_year: int) -> DataFrame:
    """J4. Years from each series' last row to the target year, never negative."""
    return _ends(df).withColumn("h", years_to(target_year))


def forward_h(today: date, target: date = FORECAST_TARGET, h: int = 0) -> int:
    """J5. Quarters past today: at least those up to the target date."""
    quarters = lambda d: d.year * 4 + (d.month - 1) // 3
    return max(h, max(0, quarters(target) - quarters(today)))


def eligible(df: DataFrame, horizons: DataFrame, max_h: int, min_obs: int = 1) -> DataFrame:
    """J6. Series neither stale nor too short."""
    keep = horizons.filter((F.col("h") <= max_h) & (F.col("n_obs") >= min_obs))
    return joins.restrict(df, keep, "unique_id")


def seasonal_naive(df: DataFrame, h: int, season: int = 4, months: int = 3) -> DataFrame:
    """Baseline forecast: the value one season back, bands from the seasonal differences.

    A series has one row per calendar bucket, so the ordered window and the season's tail are
    bounded by the calendar.
    """
    w = W.partitionBy("unique_id").orderBy("ds")
    diff = F.col("y") - F.lag("y", season).over(w)
    rows = df.withColumn("d2", diff * diff).withColumn(
        "back", F.row_number().over(W.partitionBy("unique_id").orderBy(F.col("ds").desc()))
    )
    fit = rows.groupBy("unique_id").agg(
        F.max("ds").alias("last_ds"),
        F.sqrt(F.sum("d2") / F.count("d2")).alias("sigma"),
        F.count("d2").alias("n_diff"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("back") <= season, F.struct("back", "y")))
        ).alias("tail"),
    ).filter(F.col("n_diff") > 0)
    ahead = fit.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    y_hat = F.element_at("tail", (season - F.pmod(F.col("k") - 1, F.lit(season))).cast("int"))
    spread = F.col("sigma") * F.sqrt(F.ceil(F.col("k") / season))
    return ahead.withColumn("y_hat", y_hat).withColumn("__s", spread).select(
        "unique_id",
        F.add_months("last_ds", F.col("k") * months).alias("ds"),
        F.col("k").cast("int").alias("horizon_q"),
        "y_hat",
        (F.col("y_hat") - Z_80 * F.col("__s")).alias("y_hat_lo_80"),
        (F.col("y_hat") + Z_80 * F.col("__s")).alias("y_hat_hi_80"),
        (F.col("y_hat") - Z_95 * F.col("__s")).alias("y_hat_lo_95"),
        (F.col("y_hat") + Z_95 * F.col("__s")).alias("y_hat_hi_95"),
    )


def valid_bands(fc: DataFrame) -> DataFrame:
    """J8. Forecast rows with every bound present, finite and in order."""
    present = F.lit(True)
    for c in BANDS:
        present = present & F.col(c).isNotNull()
    return fc.filter(present & ~band_violation())


def annotate(
    fc: DataFrame, today: date, index_max: date | None, model: str, method: str, split_forward: bool = False
) -> DataFrame:
    """J9. Forecast rows in table order with kind, exogenous status, model, date and method."""
    is_now = F.col("ds") <= F.lit(today)
    label: Column = F.lit(method)
    if split_forward:
        label = F.when(is_now, method).otherwise(method.replace("nowcast_", "forecast_"))
    out = fc.select(
        F.col("unique_id").alias("series_id"), *C.split_series_id("unique_id"), "ds", "horizon_q", *BANDS
    ).withColumns(
        {
            "is_nowcast": is_now,
            "cpi_is_projected": F.lit(False) if index_max is None else F.col("ds") > F.lit(index_max),
            "model": F.lit(model),
            "fit_date": F.lit(today),
            "imputation_method": label,
            "provenance_cluster_id": F.lit(None).cast("string"),
        }
    )
    return out.select(*FORECAST_COLUMNS)


def model_table(fits: DataFrame, classes: DataFrame, today: date, model: str, exog: str) -> DataFrame:
    """J10. Fitted orders, variance, AICc and coefficients with dimensions and source class."""
    out = fits.join(classes, fits.unique_id == classes.series_id, "left").select(
        F.col("unique_id").alias("series_id"),
        *C.split_series_id("unique_id"),
        F.lit(model).alias("model"),
        "ar_p", "ar_d", F.lit(0).alias("ar_q"),
        "seasonal_p", F.lit(0).alias("seasonal_d"), F.lit(0).alias("seasonal_q"),
        "seasonal_period", "sigma2", "aicc", "n_obs",
        F.to_json("coefficients").alias("coefficients_json"),
        F.lit(exog).alias("exog"),
        F.coalesce("source_class", F.lit("unknown")).alias("source_class"),
        F.lit(today).alias("fit_date"),
    )
    return out.select(*MODEL_COLUMNS)


def borrowed_models(fc: DataFrame, models: DataFrame, classes: DataFrame, today: date) -> DataFrame:
    """J11. Model rows without orders for borrowed series that no model covers."""
    ids = fc.filter(F.col("model") == "bedroom_borrowed").select("series_id", *SERIES_DIMS).distinct()
    fresh = joins.gap_fill(ids, models)
    blank = {c: F.lit(None).cast("int") for c in MODEL_COLUMNS if c.startswith(("ar_", "seasonal_"))}
    return (
        fresh.join(classes, "series_id", "left")
        .withColumns(blank)
        .withColumns(
            {
                "model": F.lit("bedroom_borrowed"),
                "sigma2": F.lit(None).cast("double"),
                "aicc": F.lit(None).cast("double"),
                "n_obs": F.lit(None).cast("int"),
                "coefficients_json": F.lit(None).cast("string"),
                "exog": F.lit("none"),
                "source_class": F.coalesce("source_class", F.lit("unknown")),
                "fit_date": F.lit(today),
            }
        )
        .select(*MODEL_COLUMNS)
    )


# --- what a chart of many regions needs -------------------------------------

SLICE = ["tier", "code", "dwelling_type", "bedrooms"]


def region_points(df: DataFrame) -> DataFrame:
    """Median rows at polygon grain: every member of a group gets the group's points."""
    rows = df.filter(F.col("statistic") == "median")
    return rows.select(
        C.tier_of().alias("tier"),
        F.explode(C.code_list("geospatial_codes")).alias("code"),
        "data_type", "dwelling_type", "bedrooms",
        F.col("time_bucket").alias("ts"), "value", C.is_imputed().alias("imputed"),
    )


def forecast_points(fc: DataFrame) -> DataFrame:
    return fc.select(
        C.tier_of().alias("tier"),
        F.explode(C.code_list("geospatial_codes")).alias("code"),
        "data_type", "dwelling_type", "bedrooms", F.col("ds").alias("ts"), F.col("y_hat").alias("value"),
    )


def yield_series(points: DataFrame, forecasts: DataFrame) -> DataFrame:
    """J17. Yield per slice present in both markets: history pairs, then forecast pairs.

    The last rental quarter of a year meets the year's sales (D11). Both markets, observed and
    forecast, go through one aggregation by (slice, year); the slice-wide flags are a window over
    those yearly rows. One point per row, with the history's composite qualifier and its own.
    """
    rows = points.withColumn("ahead", F.lit(False)).unionByName(
        forecasts.withColumns({"imputed": F.lit(None).cast("boolean"), "ahead": F.lit(True)})
    )
    is_rent, is_sale = F.col("data_type") == "rental", F.col("data_type") == "sales"
    yearly = rows.groupBy(*SLICE, "ahead", F.year("ts").alias("year")).agg(
        F.max_by(F.when(is_rent, F.col("value")), F.when(is_rent, F.col("ts"))).alias("rental_weekly"),
        F.collect_list(F.when(is_sale, F.struct("ts", "value"))).alias("sold"),
        F.bool_and(F.when(is_rent, F.col("imputed"))).alias("ri"),
        F.bool_and(F.when(is_sale, F.col("imputed"))).alias("si"),
    )
    w = W.partitionBy(*SLICE)
    market = lambda c: F.when(F.bool_and(c).over(w), "imputed").when(F.count(c).over(w) > 0, "observed")
    flagged = yearly.withColumns({"rq": market("ri"), "sq": market("si")})
    both = flagged.filter(F.col("rq").isNotNull() & F.col("sq").isNotNull() & F.col("rental_weekly").isNotNull())
    series = C.composite_qualifier("rq", "sq")
    return both.select(*SLICE, "ahead", "rental_weekly", series.alias("series_qualifier"), F.explode("sold").alias("s")).select(
        *SLICE, "s.ts", C.yield_ratio("rental_weekly", "s.value").alias("value"),
        F.when(F.col("ahead"), "forecast").otherwise(F.col("series_qualifier")).alias("qualifier"), "series_qualifier",
    )


def recover_sigma(fc: DataFrame, keys: list[str]) -> DataFrame:
    """J19. Residual sigma from the 95 % band of the nearest horizon; NULL if absent or not positive."""
    first = F.min_by(F.struct("y_hat_lo_95", "y_hat_hi_95"), "ds")
    sigma = (F.col("b.y_hat_hi_95") - F.col("b.y_hat_lo_95")) / (2 * Z_95)
    usable = (sigma > 0) & ~F.isnan(sigma) & (sigma < float("inf"))
    return fc.groupBy(*keys).agg(first.alias("b")).select(*keys, F.when(usable, sigma).alias("sigma"))


def imputed_band(df: DataFrame, sigma: DataFrame, keys: list[str]) -> DataFrame:
    """J20. Constant-width 95 % band around imputed history."""
    rows = df.filter(C.is_imputed() & (F.col("statistic") == "median"))
    margin = Z_95 * F.col("sigma")
    return rows.join(sigma.filter(F.col("sigma").isNotNull()), keys).select(
        *keys, "time_bucket", "value", (F.col("value") - margin).alias("lo"), (F.col("value") + margin).alias("hi")
    )


def forecast_bands(fc: DataFrame, keys: list[str], levels: tuple[int, ...] = (95, 80)) -> DataFrame:
    """J21. One row per forecast point and level, wide band first; a level with a NULL bound in the
    series is left out whole."""
    layers = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.col(f"y_hat_lo_{level}").alias("lo"),
                F.col(f"y_hat_hi_{level}").alias("hi"),
            )
            for level in sorted(levels, reverse=True)
        ]
    )
    rows = fc.select(*keys, "ds", "y_hat", F.explode(layers).alias("b")).select(*keys, "ds", "y_hat", "b.*")
    w = W.partitionBy(*keys, "level")
    gaps = F.count_if(F.col("lo").isNull() | F.col("hi").isNull()).over(w)
    return rows.withColumn("__gaps", gaps).filter(F.col("__gaps") == 0).drop("__gaps")


DASHES = {"observed": "solid", "partially_imputed": "dash", "fully_imputed": "dot", "forecast": "longdash"}


def segments(yields: DataFrame) -> DataFrame:
    """J22. Chart segments: history and forecast apart, each with its dash style and name."""
    dash = F.create_map(*[F.lit(x) for kv in DASHES.items() for x in kv])
    is_fc = F.col("qualifier") == "forecast"
    label = F.when(F.col("dwelling_type") == "all", "All dwellings").otherwise(
        F.concat(F.initcap("dwelling_type"), F.lit(" · "), F.col("bedrooms"), F.lit(" br"))
    )
    suffix = (
        F.when(is_fc, " · forecast")
        .when(F.col("series_qualifier") == "observed", "")
        .otherwise(F.concat(F.lit(" · "), F.replace(F.col("series_qualifier"), F.lit("_"), F.lit(" "))))
    )
    return yields.withColumns(
        {
            "segment": F.when(is_fc, "forecast").otherwise("history"),
            "dash": F.element_at(dash, F.col("qualifier")),
            "name": F.concat(label, suffix),
        }
    ).groupBy(*SLICE, "segment", "dash", "name").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
