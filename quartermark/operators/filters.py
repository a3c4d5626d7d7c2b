"""2C: projections, filters, predicates. All narrow: no shuffle unless an order is asked for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermark.functions import columns as C

REGION_ORDER = ["data_type", "dwelling_type", "bedrooms", "time_bucket"]


def medians(df: DataFrame) -> DataFrame:
    """C18."""
    return df.filter(F.col("statistic") == "median")


def region_series(df: DataFrame, tier: str, code: str) -> DataFrame:
    """C1. Every median row of one region, groups holding the region included."""
    hit = medians(df).filter((F.col("geospatial_type") == tier) & C.has_code("geospatial_codes", code))
    return hit.select(*REGION_ORDER, "value", "source_file").orderBy(*REGION_ORDER)


def by_region(table: DataFrame, tier: str, codes: list[str]) -> DataFrame:
    """C1-C3 over a table written by (tier, code): both conditions reach the reader."""
    return table.filter((F.col("tier") == tier) & F.col("code").isin(codes))


def region_forecast(df: DataFrame, tier: str, code: str) -> DataFrame:
    """C2."""
    keep = [
        "data_type", "dwelling_type", "bedrooms", "ds", "y_hat", "y_hat_lo_80", "y_hat_hi_80",
        "y_hat_lo_95", "y_hat_hi_95", "imputation_method", "is_nowcast",
    ]
    hit = df.filter((F.col("geospatial_type") == tier) & C.has_code("geospatial_codes", code))
    return hit.select(*keep).orderBy("data_type", "dwelling_type", "bedrooms", "ds")


def region_models(df: DataFrame, tier: str, code: str) -> DataFrame:
    """C3. Model rows of one region; only finite coefficients survive."""
    coef = F.map_filter(
        F.from_json("coefficients_json", "map<string,double>"),
        lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")),
    )
    hit = df.filter((F.col("geospatial_type") == tier) & C.has_code("geospatial_codes", code))
    return hit.withColumn("coefficients", coef).drop("coefficients_json").orderBy(
        "data_type", "dwelling_type", "bedrooms", "model"
    )


def index_series(df: DataFrame, region: str) -> DataFrame:
    """C4."""
    return df.filter(F.col("region") == region).orderBy("time_bucket")


def linkage(df: DataFrame, tier: str, method: str) -> DataFrame:
    """C5. On a table partitioned by (tier, method) this reads one folder."""
    return df.filter((F.col("tier") == tier) & (F.col("method") == method))


def cell_keys(
    obs: DataFrame, forecasts: DataFrame, tier: str, dwelling: str, bedrooms: str, cls: str
) -> DataFrame:
    """C6. Row keys behind one coverage cell."""
    kind = "suburb" if tier == "sal" else "lga"
    if cls == "forecast":
        rows = valid_slices(forecasts)
    else:
        rows = medians(obs).filter(C.source_class() == cls)
    cell = (
        (F.col("geospatial_type") == kind)
        & (F.col("dwelling_type") == dwelling)
        & (F.col("bedrooms") == bedrooms)
    )
    return rows.filter(cell).select("geospatial_codes").distinct()


def with_source_class(df: DataFrame) -> DataFrame:
    """C7."""
    return df.withColumn("source_class", C.source_class())


def valid_slices(df: DataFrame) -> DataFrame:
    """C8. Leaves out vacant land and the zero-bedroom code."""
    return df.filter((F.col("dwelling_type") != "vacant_land") & (F.col("bedrooms") != "0"))


def filter_or_fail(df: DataFrame, column: str, value: object, shown: int = 50) -> DataFrame:
    """C9. Equality filter whose error names the first `shown` values on offer when nothing matches."""
    hit = df.filter(F.col(column) == F.lit(value))
    if hit.isEmpty():
        offer = [r[0] for r in df.select(column).dropna().distinct().orderBy(column).limit(shown).collect()]
        raise ValueError(f"no rows with {column}={value!r}; first values on offer: {offer}")
    return hit


def drop_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """C10."""
    return df.filter(~F.coalesce(F.col(column).contains(text), F.lit(False)))


def value_range(df: DataFrame, lo: float, hi: float, column: str = "value") -> DataFrame:
    """C11."""
    return df.filter(F.col(column).between(lo, hi))


def search(df: DataFrame, text: str, code: str, name: str) -> DataFrame:
    """C12. Case-insensitive match on the name or the code."""
    q = text.strip().lower()
    return df.filter(F.lower(name).contains(q) | F.lower(code).contains(q))


def drop_empty_geom(df: DataFrame, geom: str = "geom") -> DataFrame:
    """C13."""
    return df.filter(F.col(geom).isNotNull() & (F.size(geom) > 0))


def filter_in(df: DataFrame, column: str, values: Iterable[object]) -> DataFrame:
    """C14."""
    return df.filter(F.col(column).isin(list(values)))


def keep_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """C15."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df.select(*cols)


def lookup_region(mapping: DataFrame, code: str) -> DataFrame:
    """C16."""
    return mapping.filter(F.col("code") == code)


def known_series(df: DataFrame, slices: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """C17. Listed (market, tier, dwelling, bedrooms) slices with finite values.

    The list is a literal of the program, so the filter is a pushed predicate, not a join.
    """
    key = F.concat_ws("|", "data_type", "geospatial_type", "dwelling_type", "bedrooms")
    listed = key.isin(["|".join(s) for s in slices])
    v = F.col("value")
    return df.filter(listed & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def ordered(df: DataFrame, cols: list[str | Column]) -> DataFrame:
    """G1. Ascending, NULLs last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols])
