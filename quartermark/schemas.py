"""Explicit schemas and allowed values for every table the jobs read or write."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(),
    "date": T.DateType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
}


def _schema(spec: str) -> T.StructType:
    """`name:type` words; a trailing `!` marks NOT NULL."""
    fields = []
    for word in spec.split():
        name, kind = word.split(":")
        required = kind.endswith("!")
        fields.append(T.StructField(name, _KINDS[kind.rstrip("!")], not required))
    return T.StructType(fields)


OBSERVATIONS = (
    "geospatial:string geospatial_codes:string geospatial_type:string time_bucket:date "
    "dwelling_type:string bedrooms:string dwelling_class:string statistic:string value:double "
    "data_type:string data_frequency:string source_file:string source_sheet:string cell:string"
)
CPI = "region:string time_bucket:date index_value:double"
FORECASTS = (
    "series_id:string geospatial_codes:string geospatial_type:string data_type:string "
    "dwelling_type:string bedrooms:string ds:date horizon_q:int is_nowcast:boolean! "
    "cpi_is_projected:boolean! y_hat:double y_hat_lo_80:double y_hat_hi_80:double "
    "y_hat_lo_95:double y_hat_hi_95:double model:string fit_date:date "
    "imputation_method:string! provenance_cluster_id:string"
)
FORECAST_MODELS = (
    "series_id:string geospatial_codes:string geospatial_type:string data_type:string "
    "dwelling_type:string bedrooms:string model:string! ar_p:int ar_d:int ar_q:int "
    "seasonal_p:int seasonal_d:int seasonal_q:int seasonal_period:int sigma2:double aicc:double "
    "n_obs:int coefficients_json:string exog:string source_class:string fit_date:date"
)
YIELDS = (
    "geospatial_codes:string dwelling_type:string ds:date annual_rent:double sale_price:double "
    "gross_yield:double source:string provenance_cluster_id:string"
)
DIAGNOSTICS = (
    "series_id:string mape:double smape:double ljungbox_p4:double ljungbox_p8:double jb_p:double "
    "breakvar_p:double aic:double n_obs:int"
)
CORROBORATION = (
    "lga_code:string lga_rent:double sal_cluster_level:int sal_cluster_median_rent:double "
    "divergence_pct:double"
)
HIERARCHY = (
    "node_id:string tier:string parent_cluster_id:string cluster_level:int distance:double"
)
CENTROIDS = (
    "cluster_id:string tier:string cluster_level:int n_nodes:bigint centroid_lat:double "
    "centroid_lon:double area_km2:double n_nodes_with_rental:bigint"
)
MERGES = "tier:string merge_step:int cluster_a:int cluster_b:int distance:double n_obs:bigint"
LINKAGE = (
    "tier:string! method:string! node_id:string! parent_id:string size:bigint! distance:double "
    "is_leaf:boolean!"
)
CROSSWALK = "sal_code:string lga_code:string lga_name:string"

TABLES = {
    "rental_sales": OBSERVATIONS,
    "cpi": CPI,
    "forecasts": FORECASTS,
    "forecast_models": FORECAST_MODELS,
    "yields": YIELDS,
    "forecast_diagnostics": DIAGNOSTICS,
    "forecast_diagnostics_corroboration": CORROBORATION,
    "geographic_hierarchy": HIERARCHY,
    "cluster_centroids": CENTROIDS,
    "linkage_matrix": MERGES,
    "cluster_linkage": LINKAGE,
    "crosswalk": CROSSWALK,
}


def schema(table: str) -> T.StructType:
    return _schema(TABLES[table])


OBS_COLUMNS = [w.split(":")[0] for w in OBSERVATIONS.split()]
FORECAST_COLUMNS = [w.split(":")[0] for w in FORECASTS.split()]
MODEL_COLUMNS = [w.split(":")[0] for w in FORECAST_MODELS.split()]
YIELD_COLUMNS = [w.split(":")[0] for w in YIELDS.split()]
SERIES_DIMS = ["data_type", "geospatial_type", "geospatial_codes", "dwelling_type", "bedrooms"]
BANDS = ["y_hat_lo_95", "y_hat_lo_80", "y_hat", "y_hat_hi_80", "y_hat_hi_95"]

IMPUTED_PREFIX = "imputed:"

# The method labels stored in forecast rows.
DIRECT_METHODS = [
    "observed",
    "nowcast_sarima_cpi",
    "nowcast_sarima_annual",
    "nowcast_yield_bridge_direct",
    "nowcast_bedroom_borrowed",
    "nowcast_direct_sarima_low_n",
    "forecast_sarima_cpi",
    "forecast_sarima_annual",
    "forecast_yield_bridge_direct",
    "forecast_bedroom_borrowed",
    "forecast_direct_sarima_low_n",
]
CLUSTER_METHODS = [
    "nowcast_yield_bridge_sal_cluster",
    "nowcast_yield_bridge_lga_cluster",
    "forecast_yield_bridge_sal_cluster",
    "forecast_yield_bridge_lga_cluster",
]
METHODS = DIRECT_METHODS + CLUSTER_METHODS

# Slices of the market cube (dwelling, bedrooms).
SLICES = [
    ("all", "all"),
    ("house", "all"),
    ("house", "2"),
    ("house", "3"),
    ("house", "4"),
    ("unit", "all"),
    ("unit", "1"),
    ("unit", "2"),
    ("unit", "3"),
]

# Two-sided normal quantiles for 80 % and 95 % bands.
Z_80 = 1.2815515655446004
Z_95 = 1.959963984540054
