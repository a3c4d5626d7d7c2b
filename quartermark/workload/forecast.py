"""Queries of 2J and the forecast checks of 2M."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import aggs, filters, joins, quality
from quartermark.plans import models as M
from quartermark.plans import series as S
from quartermark.plans import yields as Y
from quartermark.schemas import METHODS, SERIES_DIMS, schema
from quartermark.session import cut
from quartermark.workload import base as B
from quartermark.workload.base import VIEWS, query, r6

BANDS_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in ["y_hat", "y_hat_lo_80", "y_hat_hi_80", "y_hat_lo_95", "y_hat_hi_95"])


def _bands(df):
    return df.withColumns({c: r6(c) for c in df.columns if c.startswith("y_hat")})


def _long(spark, sf):
    return S.long_frame(B.filled_a(spark, sf))


def _rental(spark, sf, o=None):
    return B.rental_long(spark, sf, o)


def _index(spark, sf):
    return filters.index_series(B.cpi(spark, sf), B.INDEX_REGION)


@query("J1_long_frame", "SELECT unique_id, ds, round(y, 6) AS y FROM long")
def _(spark, sf):
    return _long(spark, sf).withColumn("y", r6("y"))


@query("J2_infer_grid", "SELECT CASE WHEN bool_and(month(ds) IN (3, 6, 9, 12)) THEN 'QS-DEC' WHEN bool_and(month(ds) IN (2, 5, 8, 11)) THEN 'QS-NOV' ELSE 'QS' END AS grid FROM long WHERE unique_id LIKE 'rental|%'")
def _(spark, sf):
    return S.infer_grid(_rental(spark, sf))


@query("J3_carry_forward", """
SELECT region, time_bucket, index_value FROM cpi UNION ALL
SELECT region, CAST(max(time_bucket) + to_months(CAST(3 * k AS INTEGER)) AS DATE), arg_max(index_value, time_bucket) FROM cpi CROSS JOIN (VALUES (1), (2), (3), (4)) v(k) GROUP BY region, k""")
def _(spark, sf):
    return S.carry_forward(B.cpi(spark, sf), 4)


@query("J4_nowcast_horizon", "SELECT unique_id, max(ds) AS last_ds, count(*) AS n_obs, CAST(greatest(0, 2002 * 4 + 1 - (year(max(ds)) * 4 + quarter(max(ds)) - 1)) AS INTEGER) AS h FROM long WHERE unique_id LIKE 'rental|%' GROUP BY 1")
def _(spark, sf):
    return S.nowcast_h(_rental(spark, sf), B.TODAY)


@query("J4_annual_horizon", "SELECT unique_id, max(ds) AS last_ds, count(*) AS n_obs, CAST(greatest(0, 2002 - year(max(ds))) AS INTEGER) AS h FROM long WHERE unique_id LIKE 'sales|%' GROUP BY 1")
def _(spark, sf):
    return S.annual_h(B.sales_long(spark, sf), 2002)


@query("J5_forward_horizon", """
SELECT unique_id, greatest(0, 2002 * 4 + 1 - (year(max(ds)) * 4 + quarter(max(ds)) - 1)) + 6 AS total_h FROM long WHERE unique_id LIKE 'rental|%' GROUP BY 1""")
def _(spark, sf):
    own = S.nowcast_h(_rental(spark, sf), B.TODAY)
    ahead = S.forward_h(B.TODAY, date(2003, 12, 31))
    return own.select("unique_id", (F.col("h") + ahead).cast("bigint").alias("total_h"))


@query("J6_eligible", """
SELECT unique_id, ds, round(y, 6) AS y FROM long WHERE unique_id IN (SELECT unique_id FROM long WHERE unique_id LIKE 'rental|%' GROUP BY 1
HAVING count(*) >= 28 AND 2002 * 4 + 1 - (year(max(ds)) * 4 + quarter(max(ds)) - 1) <= 2)""")
def _(spark, sf):
    rows = _rental(spark, sf)
    return S.eligible(rows, S.nowcast_h(rows, B.TODAY), 2, 28).withColumn("y", r6("y"))


def _fit_inputs(spark, sf, o=None):
    # Read by the join with the series and as the path ahead.
    index = cut(S.carry_forward(_index(spark, sf), 12))
    return joins.with_exog(_rental(spark, sf, o), index), index


def _horizon():
    """Quarters to today plus two ahead, and the stale-series rule, over a folded series."""
    return S.quarters_to(B.TODAY) + 2, S.quarters_to(B.TODAY) <= S.STALE_QUARTERS


@query("J7_fit_forecast")
def _(spark, sf):
    train, index = _fit_inputs(spark, sf)
    h, fresh = _horizon()
    fc = S.valid_bands(M.fit_forecast(train, h, 4, 3, index, keep=fresh))
    return S.annotate(fc, B.TODAY, date(2001, 9, 1), "ar_cpi_q", "nowcast_sarima_cpi")


@query("J7_fit_forecast_annual")
def _(spark, sf):
    h = S.years_to(2003)
    keep = (h <= S.STALE_YEARS) & (F.col("n_obs") >= S.MIN_ANNUAL)
    fc = S.valid_bands(M.fit_forecast(B.sales_long(spark, sf), h, 1, 12, keep=keep))
    return S.annotate(fc, B.TODAY, None, "ar_annual", "nowcast_sarima_annual")


@query("J7_seasonal_naive", f"SELECT unique_id, ds, horizon_q, {BANDS_SQL} FROM naive WHERE unique_id LIKE 'rental|%'")
def _(spark, sf):
    return _bands(S.seasonal_naive(_rental(spark, sf), 4))


@query("J8_valid_bands", f"SELECT unique_id, ds, horizon_q, {BANDS_SQL} FROM naive WHERE unique_id LIKE 'rental|%' AND horizon_q % 2 = 1 AND y_hat_lo_95 <= y_hat")
def _(spark, sf):
    fc = S.seasonal_naive(_rental(spark, sf), 4)
    # Break the order of every second step: those rows must go.
    broken = fc.withColumn("y_hat_lo_95", F.when(F.col("horizon_q") % 2 == 0, F.col("y_hat_hi_95") + 1).otherwise(F.col("y_hat_lo_95")))
    return _bands(S.valid_bands(broken))


@query("J9_annotate", "SELECT series_id, geospatial_codes, ds, is_nowcast, cpi_is_projected, model, fit_date, CASE WHEN is_nowcast THEN imputation_method ELSE replace(imputation_method, 'nowcast', 'forecast') END AS imputation_method FROM fc WHERE data_type = 'rental'")
def _(spark, sf):
    fc = S.annotate(S.seasonal_naive(_rental(spark, sf), 4), B.TODAY, date(2001, 9, 1), "naive_q", "nowcast_sarima_cpi", split_forward=True)
    return fc.select("series_id", "geospatial_codes", "ds", "is_nowcast", "cpi_is_projected", "model", "fit_date", "imputation_method")


def _models(spark, sf, o=None):
    o = B.obs_table(spark, sf) if o is None else o
    train, index = _fit_inputs(spark, sf, o)
    h, fresh = _horizon()
    return S.model_table(M.fit(train, h, 4, 3, index, keep=fresh), aggs.source_class(B.filled_a(spark, sf, o)), B.TODAY, "ar_cpi_q", "cpi")


@query("J10_model_table")
def _(spark, sf):
    return _models(spark, sf)


@query("C3_region_models")
def _(spark, sf):
    # Series are fitted one by one, so only those of the region are.
    own = (F.col("geospatial_type") == "suburb") & C.has_code("geospatial_codes", "20003")
    out = filters.region_models(_models(spark, sf, cut(B.obs(spark, sf).filter(own))), "suburb", "20003")
    return out.withColumn("n_coefficients", F.size("coefficients")).drop("coefficients")


VIEWS["borrowed"] = """
  SELECT 'sales|suburb|' || y.geospatial_codes || '|' || b.dwelling_type || '|' || b.bedrooms AS series_id, y.geospatial_codes, b.dwelling_type, b.bedrooms,
         make_date(arg_min(b.yr, (length(b.grp), b.grp)), 12, 1) AS ds, arg_min(b.rent, (length(b.grp), b.grp)) / y.gy AS y_hat
  FROM (SELECT grp, dwelling_type, bedrooms, max(yr) AS yr, arg_max(v, yr) AS rent
        FROM (SELECT geospatial_codes AS grp, dwelling_type, bedrooms, year(time_bucket) AS yr, avg(value) * 52 AS v FROM obs
              WHERE data_type = 'rental' AND geospatial_type = 'suburb' AND statistic = 'median' AND bedrooms <> 'all' GROUP BY ALL) GROUP BY ALL) b
  JOIN (SELECT geospatial_codes, dwelling_type, arg_max(gross_yield, ds) AS gy FROM yld GROUP BY ALL) y
    ON y.dwelling_type = b.dwelling_type AND '-' || b.grp || '-' LIKE '%-' || y.geospatial_codes || '-%'
  WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.series_id = 'sales|suburb|' || y.geospatial_codes || '|' || b.dwelling_type || '|' || b.bedrooms)
  GROUP BY y.geospatial_codes, b.dwelling_type, b.bedrooms, y.gy"""


def _borrowed(spark, sf, o=None):
    o = B.obs_table(spark, sf) if o is None else o
    return Y.borrowed_sales(o, B.yields_view(spark, sf, o), B.forecasts(spark, sf, o), B.TODAY)


@query("J11_borrowed_models", "SELECT series_id, geospatial_codes, 'bedroom_borrowed' AS model, 'none' AS exog, 'unknown' AS source_class, CAST(NULL AS INTEGER) AS ar_p FROM borrowed")
def _(spark, sf):
    o = B.obs_table(spark, sf)
    fc = _borrowed(spark, sf, o)
    none = spark.createDataFrame([], schema("forecast_models"))
    out = S.borrowed_models(fc, none, aggs.source_class(o), B.TODAY)
    return out.select("series_id", "geospatial_codes", "model", "exog", "source_class", "ar_p")


@query("J12_backtest")
def _(spark, sf):
    train, index = _fit_inputs(spark, sf)
    return M.backtest(train, index)


@query("J12_backtest_rolling")
def _(spark, sf):
    train, index = _fit_inputs(spark, sf)
    return M.backtest(train, index, folds=3)


NAIVE_BACK = """
SELECT a.unique_id AS series_id, round(avg(abs(a.y - p.y) / nullif((abs(a.y) + abs(p.y)) / 2, 0)), 9) AS smape, count(*) AS n_scored
FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM long WHERE unique_id LIKE 'rental|%') a
JOIN (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM long) p ON p.unique_id = a.unique_id
JOIN (SELECT unique_id, max(ds) FILTER (WHERE back = 5) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM long) GROUP BY 1 HAVING count(*) >= 9) c ON c.unique_id = a.unique_id
JOIN (VALUES (1), (2), (3), (4)) v(k) ON p.back = 9 - k AND a.ds = CAST(c.cut + to_months(CAST(3 * k AS INTEGER)) AS DATE)
WHERE a.back <= 4 GROUP BY 1"""


@query("E17_smape", NAIVE_BACK)
def _(spark, sf):
    return M.naive_backtest(_rental(spark, sf)).withColumn("smape", r6("smape", 9))


YIELD_SQL = "SELECT geospatial_codes, dwelling_type, ds, round(annual_rent, 6) AS annual_rent, sale_price, round(annual_rent / sale_price, 9) AS gross_yield, source, provenance_cluster_id FROM "


def _yield_cols(df):
    return df.withColumns({"annual_rent": r6("annual_rent"), "gross_yield": r6("gross_yield", 9)})


@query("J13_direct_yields", YIELD_SQL + "direct")
def _(spark, sf):
    return _yield_cols(Y.direct_yields(B.obs(spark, sf)))


@query("J14_fallback_yields", YIELD_SQL + "fallback")
def _(spark, sf):
    rows = B.obs(spark, sf)
    return _yield_cols(Y.fallback_yields(rows, Y.direct_yields(rows), B.hierarchy(spark, sf)))


@query("J15_borrowed_sales", "SELECT series_id, geospatial_codes, dwelling_type, bedrooms, ds, round(y_hat, 4) AS y_hat, 'bedroom_borrowed' AS model, 'nowcast_bedroom_borrowed' AS imputation_method FROM borrowed")
def _(spark, sf):
    out = _borrowed(spark, sf).select("series_id", "geospatial_codes", "dwelling_type", "bedrooms", "ds", "y_hat", "model", "imputation_method")
    return out.withColumn("y_hat", r6("y_hat", 4))


@query("J16_corroborate", """
SELECT o.geospatial_codes AS lga_code, round(o.rent, 6) AS lga_rent, c.cluster_level AS sal_cluster_level, round(c.med, 6) AS sal_cluster_median_rent, round((c.med - o.rent) / o.rent * 100, 6) AS divergence_pct
FROM overall o CROSS JOIN (SELECT cluster_level, median(rent) AS med FROM hier JOIN overall ON geospatial_codes = node_id GROUP BY 1 ORDER BY 1 DESC LIMIT 1) c WHERE o.geospatial_type = 'lga'""")
def _(spark, sf):
    out = Y.corroborate(B.obs(spark, sf), B.hierarchy(spark, sf))
    return out.withColumns({c: r6(c) for c in ("lga_rent", "sal_cluster_median_rent", "divergence_pct")})


VIEWS["pts"] = """
  SELECT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, unnest(string_split(geospatial_codes, '-')) AS code, data_type, dwelling_type, bedrooms,
         time_bucket AS ts, value, source_file LIKE 'imputed:%' AS imputed FROM filled WHERE statistic = 'median'"""
VIEWS["fpts"] = """
  SELECT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, unnest(string_split(geospatial_codes, '-')) AS code, data_type, dwelling_type, bedrooms,
         ds AS ts, y_hat AS value FROM fc"""
VIEWS["yser"] = """
  SELECT s.*, CASE f WHEN 1 THEN 'forecast' ELSE sq END AS qualifier, sq AS series_qualifier
  FROM (SELECT r.tier, r.code, r.dwelling_type, r.bedrooms, z.ts, arg_max(r.value, r.ts) * 52 / z.value AS value, r.f FROM
        (SELECT tier, code, dwelling_type, bedrooms, ts, value, data_type, 0 AS f FROM pts UNION ALL SELECT tier, code, dwelling_type, bedrooms, ts, value, data_type, 1 FROM fpts) r JOIN
        (SELECT tier, code, dwelling_type, bedrooms, ts, value, data_type, 0 AS f FROM pts UNION ALL SELECT tier, code, dwelling_type, bedrooms, ts, value, data_type, 1 FROM fpts) z
        ON z.tier = r.tier AND z.code = r.code AND z.dwelling_type = r.dwelling_type AND z.bedrooms = r.bedrooms AND z.f = r.f AND year(z.ts) = year(r.ts)
        WHERE r.data_type = 'rental' AND z.data_type = 'sales' GROUP BY r.tier, r.code, r.dwelling_type, r.bedrooms, z.ts, z.value, r.f) s
  JOIN (SELECT tier, code, dwelling_type, bedrooms, CASE WHEN n = 2 THEN 'fully_imputed' WHEN n = 1 THEN 'partially_imputed' ELSE 'observed' END AS sq
        FROM (SELECT tier, code, dwelling_type, bedrooms, sum(i)::INTEGER AS n FROM (SELECT tier, code, dwelling_type, bedrooms, data_type, bool_and(imputed)::INTEGER AS i FROM pts GROUP BY ALL)
              GROUP BY ALL HAVING count(*) = 2)) q USING (tier, code, dwelling_type, bedrooms)"""


def _yser(spark, sf):
    o = B.obs_table(spark, sf)
    return S.yield_series(S.region_points(B.filled(spark, sf, o)), S.forecast_points(B.forecasts(spark, sf, o)))


@query("J17_yield_series", "SELECT tier, code, dwelling_type, bedrooms, ts, round(value, 9) AS value, qualifier, series_qualifier FROM yser")
def _(spark, sf):
    return _yser(spark, sf).withColumn("value", r6("value", 9))


@query("D11_align_annual", """
SELECT geospatial_codes, dwelling_type, z.ts, arg_max(q.value, q.ts) AS rental_weekly, z.value AS sale_price FROM
(SELECT geospatial_codes, dwelling_type, time_bucket AS ts, value FROM obs WHERE statistic = 'median' AND data_type = 'rental' AND bedrooms = '2') q JOIN
(SELECT geospatial_codes, dwelling_type, time_bucket AS ts, value FROM obs WHERE data_type = 'sales') z USING (geospatial_codes, dwelling_type) WHERE year(q.ts) = year(z.ts) GROUP BY ALL""")
def _(spark, sf):
    rows = filters.medians(B.obs(spark, sf)).withColumnRenamed("time_bucket", "ts").select("geospatial_codes", "dwelling_type", "ts", "value", "data_type", "bedrooms")
    q = rows.filter((F.col("data_type") == "rental") & (F.col("bedrooms") == "2")).drop("data_type", "bedrooms")
    z = rows.filter(F.col("data_type") == "sales").drop("data_type", "bedrooms")
    return joins.align_annual(q, z, ["geospatial_codes", "dwelling_type"])


@query("D13_attach_forecast", """
SELECT a.series_id, a.n_points, count(f.ds) AS n_forecast, round(max(f.y_hat), 6) AS top FROM (SELECT unique_id AS series_id, count(*) AS n_points FROM long GROUP BY 1) a LEFT JOIN fc f USING (series_id) GROUP BY ALL""")
def _(spark, sf):
    o = B.obs_table(spark, sf)
    series = aggs.to_series(filters.medians(B.filled_a(spark, sf, o)), SERIES_DIMS).withColumn("series_id", C.series_id())
    out = joins.attach_forecast(series, aggs.forecast_series(B.forecasts(spark, sf, o), ["series_id"]), ["series_id"])
    top = F.array_max(F.transform("forecast", lambda p: p["y_hat"]))
    return out.select("series_id", F.size("points").cast("bigint").alias("n_points"), F.coalesce(F.size("forecast"), F.lit(0)).cast("bigint").alias("n_forecast"), r6(top).alias("top"))


@query("J18_composite_qualifier", "SELECT tier, series_qualifier, qualifier, count(*) AS n FROM yser GROUP BY ALL")
def _(spark, sf):
    return _yser(spark, sf).groupBy("tier", "series_qualifier", "qualifier").agg(F.count(F.lit(1)).alias("n"))


@query("J19_recover_sigma", "SELECT series_id, round(CASE WHEN s > 0 THEN s END, 6) AS sigma FROM (SELECT series_id, (arg_min(y_hat_hi_95, ds) - arg_min(y_hat_lo_95, ds)) / (2 * 1.959963984540054) AS s FROM fc GROUP BY 1)")
def _(spark, sf):
    return S.recover_sigma(B.forecasts(spark, sf), ["series_id"]).withColumn("sigma", r6("sigma"))


@query("J20_imputed_band", """
SELECT series_id, ds AS time_bucket, round(y, 6) AS value, round(y - 1.959963984540054 * s, 6) AS lo, round(y + 1.959963984540054 * s, 6) AS hi
FROM (SELECT unique_id AS series_id, ds, y FROM long WHERE unique_id LIKE 'rental|%|all' AND unique_id NOT LIKE '%|all|all')
JOIN (SELECT series_id, (arg_min(y_hat_hi_95, ds) - arg_min(y_hat_lo_95, ds)) / (2 * 1.959963984540054) AS s FROM fc GROUP BY 1) USING (series_id) WHERE s > 0""")
def _(spark, sf):
    rows = B.filled_a(spark, sf).withColumn("series_id", C.series_id())
    out = S.imputed_band(rows, S.recover_sigma(B.forecasts(spark, sf), ["series_id"]), ["series_id"])
    return out.withColumns({c: r6(c) for c in ("value", "lo", "hi")})


@query("J21_forecast_bands", """
SELECT series_id, ds, round(y_hat, 6) AS y_hat, 95 AS level, round(y_hat_lo_95, 6) AS lo, round(y_hat_hi_95, 6) AS hi FROM fc
UNION ALL SELECT series_id, ds, round(y_hat, 6), 80, round(y_hat_lo_80, 6), round(y_hat_hi_80, 6) FROM fc
WHERE series_id NOT IN (SELECT series_id FROM fc WHERE data_type = 'sales')""")
def _(spark, sf):
    # Sales lose one 80 % bound: that whole level must go.
    fc = B.forecasts(spark, sf)
    gap = (F.col("data_type") == "sales") & (F.col("horizon_q") == 1)
    holed = fc.withColumn("y_hat_lo_80", F.when(~gap, F.col("y_hat_lo_80")))
    return S.forecast_bands(holed, ["series_id"]).withColumns({c: r6(c) for c in ("y_hat", "lo", "hi")})


@query("J22_segments", """
SELECT tier, code, dwelling_type, bedrooms, CASE qualifier WHEN 'forecast' THEN 'forecast' ELSE 'history' END AS segment,
  CASE qualifier WHEN 'observed' THEN 'solid' WHEN 'partially_imputed' THEN 'dash' WHEN 'fully_imputed' THEN 'dot' ELSE 'longdash' END AS dash,
  CASE dwelling_type WHEN 'all' THEN 'All dwellings' ELSE upper(dwelling_type[1]) || dwelling_type[2:] || ' · ' || bedrooms || ' br' END
    || CASE qualifier WHEN 'forecast' THEN ' · forecast' WHEN 'observed' THEN '' ELSE ' · ' || replace(qualifier, '_', ' ') END AS name,
  count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts FROM yser GROUP BY ALL""")
def _(spark, sf):
    return S.segments(_yser(spark, sf))


# --- 2M over forecasts -----------------------------------------------------------


@query("M1_quality_gate", f"""
SELECT split_part(series_id, '|', 1) AS data_type, round(median(smape), 9) AS median_smape, count(*) AS n_series, CAST(0.15 AS DOUBLE) AS threshold, median(smape) > 0.15 AS breach
FROM ({NAIVE_BACK}) GROUP BY 1""")
def _(spark, sf):
    diag = M.naive_backtest(_rental(spark, sf)).withColumn("smape", r6("smape", 9))
    return quality.quality_gate(diag).withColumn("median_smape", r6("median_smape", 9))


@query("M2_check_bands", "SELECT model, count(*) AS n_rows, count(*) FILTER (WHERE horizon_q = 2) AS n_violations FROM fc GROUP BY 1")
def _(spark, sf):
    fc = B.forecasts(spark, sf)
    return quality.check_bands(fc.withColumn("y_hat_hi_80", F.when(F.col("horizon_q") == 2, F.col("y_hat_hi_95") + 1).otherwise(F.col("y_hat_hi_80"))))


@query("M3_check_provenance", "SELECT count(*) FILTER (WHERE data_type = 'rental' AND horizon_q = 1) AS direct_with_cluster, count(*) FILTER (WHERE data_type = 'sales') AS cluster_without_id FROM fc")
def _(spark, sf):
    fc = B.forecasts(spark, sf)
    spoiled = fc.withColumns({
        "provenance_cluster_id": F.when((F.col("data_type") == "rental") & (F.col("horizon_q") == 1), "sal_L5_C0"),
        "imputation_method": F.when(F.col("data_type") == "sales", "nowcast_yield_bridge_sal_cluster").otherwise(F.col("imputation_method")),
    })
    return quality.check_provenance(spoiled)


@query("M4_check_schema", """
SELECT 'fit_date' AS "column", true AS type_ok, 0 AS n_null, 0 AS n_off_list UNION ALL SELECT 'imputation_method', true, 0, count(*) FILTER (WHERE data_type = 'sales') FROM fc
UNION ALL SELECT 'is_nowcast', true, count(*) FILTER (WHERE horizon_q = 3), 0 FROM fc UNION ALL SELECT 'y_hat', true, 0, 0""")
def _(spark, sf):
    fc = B.forecasts(spark, sf)
    spoiled = fc.withColumns({
        "is_nowcast": F.when(F.col("horizon_q") != 3, F.col("is_nowcast")),
        "imputation_method": F.when(F.col("data_type") == "sales", "guess").otherwise(F.col("imputation_method")),
    })
    report = quality.check_schema(spoiled, schema("forecasts"), {"imputation_method": METHODS})
    return report.filter(F.col("column").isin("is_nowcast", "imputation_method", "fit_date", "y_hat"))


@query("M7_yield_envelope", "SELECT source, count(*) AS n_yields, count(*) FILTER (WHERE gross_yield NOT BETWEEN 0.01 AND 0.05) AS n_outside FROM yld GROUP BY 1")
def _(spark, sf):
    return quality.yield_envelope(B.yields_view(spark, sf), 0.01, 0.05)
