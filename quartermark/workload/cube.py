"""Queries of 2C-2I and 2M over the derived observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import aggs, bitmaps, filters, joins, medians, quality, sets, windows
from quartermark.plans import impute as I
from quartermark.plans import series as S
from quartermark.plans import yields as Y
from quartermark.schemas import SERIES_DIMS, SLICES
from quartermark.session import cut
from quartermark.sources import sinks
from quartermark.workload import base as B
from quartermark.workload.base import query, r6

OBS_ALL = "geospatial, geospatial_codes, geospatial_type, time_bucket, dwelling_type, bedrooms, dwelling_class, statistic, {v} AS value, data_type, data_frequency, source_file, source_sheet, cell"

# --- 2C ----------------------------------------------------------------------


@query("C1_region_series", """
SELECT data_type, dwelling_type, bedrooms, time_bucket, value, source_file FROM obs
WHERE statistic = 'median' AND geospatial_type = 'suburb' AND '-' || geospatial_codes || '-' LIKE '%-20001-%'""")
def _(spark, sf):
    return filters.region_series(B.obs(spark, sf), "suburb", "20001")


@query("C1_regions_prepared", """
SELECT code, 'series' AS part, data_type, dwelling_type, bedrooms, time_bucket AS at, value FROM
  (SELECT *, unnest(string_split(geospatial_codes, '-')) AS code FROM obs WHERE statistic = 'median' AND geospatial_type = 'suburb') WHERE code IN ('20001', '20003', '20004')
UNION ALL SELECT code, 'forecast', data_type, dwelling_type, bedrooms, ds, round(y_hat, 6) FROM
  (SELECT *, unnest(string_split(geospatial_codes, '-')) AS code FROM fc WHERE geospatial_type = 'suburb') WHERE code IN ('20001', '20003', '20004')""")
def _(spark, sf):
    """Series and forecasts of a set of regions in one plan, read from the prepared tables."""
    o, codes = B.obs_table(spark, sf), ["20001", "20003", "20004"]
    series = spark.read.parquet(sinks.write_by_region(filters.medians(o), sinks.scratch_path(spark, "series")))
    ahead = spark.read.parquet(sinks.write_by_region(B.forecasts(spark, sf, o), sinks.scratch_path(spark, "ahead")))
    cols = ["code", "part", "data_type", "dwelling_type", "bedrooms", "at", "value"]
    a = filters.by_region(series, "suburb", codes).withColumns({"part": F.lit("series"), "at": F.col("time_bucket")})
    b = filters.by_region(ahead, "suburb", codes).withColumns({"part": F.lit("forecast"), "at": F.col("ds"), "value": r6("y_hat")})
    return a.select(*cols).unionByName(b.select(*cols)).withColumn("code", F.col("code").cast("string"))


@query("C2_region_forecast", """
SELECT data_type, dwelling_type, bedrooms, ds, round(y_hat, 6) AS y_hat, round(y_hat_lo_80, 6) AS y_hat_lo_80,
  round(y_hat_hi_80, 6) AS y_hat_hi_80, round(y_hat_lo_95, 6) AS y_hat_lo_95, round(y_hat_hi_95, 6) AS y_hat_hi_95,
  imputation_method, is_nowcast
FROM fc WHERE geospatial_type = 'suburb' AND '-' || geospatial_codes || '-' LIKE '%-20003-%'""")
def _(spark, sf):
    out = filters.region_forecast(B.forecasts(spark, sf), "suburb", "20003")
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith("y_hat")})


@query("C4_index_series", "SELECT region, time_bucket, index_value FROM cpi WHERE region = '1-URGENT'")
def _(spark, sf):
    return filters.index_series(B.cpi(spark, sf), B.INDEX_REGION)


def _cell(cls):
    def run(spark, sf):
        rows = B.filled_a(spark, sf)
        fc = B.forecasts(spark, sf) if cls == "forecast" else rows
        return filters.cell_keys(rows, fc, "sal", "house", "all" if cls == "imputed" else "3", cls)

    return run


query("C6_cell_keys_observed", "SELECT DISTINCT geospatial_codes FROM filled_a WHERE statistic = 'median' AND geospatial_type = 'suburb' AND dwelling_type = 'house' AND bedrooms = '3' AND source_file NOT LIKE 'imputed:%'")(_cell("observed"))
query("C6_cell_keys_imputed", "SELECT DISTINCT geospatial_codes FROM filled_a WHERE statistic = 'median' AND geospatial_type = 'suburb' AND dwelling_type = 'house' AND bedrooms = 'all' AND source_file LIKE 'imputed:%'")(_cell("imputed"))
query("C6_cell_keys_forecast", "SELECT DISTINCT geospatial_codes FROM fc WHERE geospatial_type = 'suburb' AND dwelling_type = 'house' AND bedrooms = '3'")(_cell("forecast"))


@query("C7_source_class", """
SELECT geospatial_type, CASE WHEN source_file LIKE 'imputed:%' THEN 'imputed' ELSE 'observed' END AS source_class,
  count(*) AS n, sum(round(value, 6)) AS total FROM filled_a WHERE statistic = 'count' GROUP BY ALL""")
def _(spark, sf):
    rows = filters.with_source_class(B.filled_a(spark, sf)).filter(F.col("statistic") == "count")
    return rows.groupBy("geospatial_type", "source_class").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("C8_valid_slices", "SELECT geospatial_codes, time_bucket, dwelling_type, bedrooms, statistic, value FROM obs WHERE dwelling_type <> 'vacant_land' AND bedrooms <> '0' AND data_type = 'rental'")
def _(spark, sf):
    rows = filters.valid_slices(B.obs(spark, sf)).filter(F.col("data_type") == "rental")
    return rows.select("geospatial_codes", "time_bucket", "dwelling_type", "bedrooms", "statistic", "value")


@query("C9_filter_or_fail", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier)")
def _(spark, sf):
    sup = B.table(spark, sf, "supplier")
    first = sup.agg(F.min("s_nationkey")).first()[0]
    return filters.filter_or_fail(sup, "s_nationkey", first).select("s_suppkey", "s_name")


@query("C10_drop_containing", "SELECT page_id, url FROM pages WHERE url NOT LIKE '%/fr/%'")
def _(spark, sf):
    return filters.drop_containing(B.table(spark, sf, "pages").select("page_id", "url"), "url", "/fr/")


@query("C11_value_range", "SELECT geospatial_codes, time_bucket, dwelling_type, bedrooms, value FROM obs WHERE statistic = 'median' AND data_type = 'rental' AND value BETWEEN 400 AND 500")
def _(spark, sf):
    rows = filters.medians(B.obs(spark, sf)).filter(F.col("data_type") == "rental")
    return filters.value_range(rows, 400, 500).select("geospatial_codes", "time_bucket", "dwelling_type", "bedrooms", "value")


@query("C12_search", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%r#0000000%' OR CAST(c_custkey AS VARCHAR) LIKE '%r#0000000%'")
def _(spark, sf):
    cust = B.table(spark, sf, "customer").select("c_custkey", "c_name")
    return filters.search(cust, " R#0000000", "c_custkey", "c_name")


@query("C14_filter_in", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, sf):
    ev = filters.filter_in(B.table(spark, sf, "events"), "event_type", ["click", "view"])
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("C15_keep_columns", "SELECT p_partkey, p_type FROM part")
def _(spark, sf):
    return filters.keep_columns(B.table(spark, sf, "part"), ["p_partkey", "p_type"])


@query("C17_known_series", """
SELECT geospatial_codes, time_bucket, dwelling_type, bedrooms, value FROM obs WHERE statistic = 'median' AND data_type = 'rental'
AND geospatial_type = 'suburb' AND (dwelling_type || bedrooms) IN ('house2', 'house3', 'unit1', 'allall')""")
def _(spark, sf):
    listed = [("rental", "suburb", d, b) for d, b in [("house", "2"), ("house", "3"), ("unit", "1"), ("all", "all")]]
    rows = filters.known_series(filters.medians(B.obs(spark, sf)), listed)
    return rows.select("geospatial_codes", "time_bucket", "dwelling_type", "bedrooms", "value")


@query("C18_medians", "SELECT data_type, geospatial_type, count(*) AS n, sum(value) AS total FROM obs WHERE statistic = 'median' GROUP BY ALL")
def _(spark, sf):
    return filters.medians(B.obs(spark, sf)).groupBy("data_type", "geospatial_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# --- 2D ----------------------------------------------------------------------


@query("D1_bedroom_ratios", "SELECT grp AS geospatial_codes, dwelling_type, bedrooms, y AS year, round(ratio, 9) AS ratio FROM ratio")
def _(spark, sf):
    return I.bedroom_ratios(B.filled_a(spark, sf)).withColumn("ratio", r6("ratio", 9)).withColumn("year", F.col("year").cast("bigint"))


@query("D2_left_default", """
SELECT geospatial_codes, dwelling_type, y AS year, value, coalesce(w, 1.0) AS w FROM sold z
LEFT JOIN (SELECT grp, dwelling_type AS dt, y AS yy, avg(v) AS w FROM rent_year WHERE statistic = 'count' AND bedrooms = '2' GROUP BY ALL) q
ON grp = geospatial_codes AND dt = dwelling_type AND yy = y""")
def _(spark, sf):
    rows = B.obs(spark, sf)
    w = aggs.annual_mean(I._rental(rows, "count").filter(F.col("bedrooms") == "2"), ["geospatial_codes", "dwelling_type"], name="w")
    sold = I._sales_all(rows).select("geospatial_codes", "dwelling_type", "year", "value")
    out = joins.left_default(sold, w, ["geospatial_codes", "dwelling_type", "year"], "w", 1.0)
    return out.withColumn("year", F.col("year").cast("bigint"))


@query("D3_containment_join", """
SELECT z.geospatial_codes, q.grp AS group_codes, z.dwelling_type, z.y AS year, z.value, q.v AS w FROM sold z
JOIN rent_year q ON q.dwelling_type = z.dwelling_type AND q.y = z.y AND '-' || q.grp || '-' LIKE '%-' || z.geospatial_codes || '-%'
WHERE q.statistic = 'count' AND q.bedrooms = 'all'""")
def _(spark, sf):
    rows = B.filled_a(spark, sf)
    w = aggs.annual_mean(I._rental(rows, "count").filter(F.col("bedrooms") == "all"), ["geospatial_codes", "dwelling_type"], name="w")
    sold = I._sales_all(rows).select("geospatial_codes", "dwelling_type", "year", "value")
    return joins.containment_join(sold, w, ["dwelling_type", "year"]).withColumn("year", F.col("year").cast("bigint"))


@query("D4_orphans", "SELECT geospatial_codes, dwelling_type, y AS year, value AS sale_price FROM sold z WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.geospatial_codes = z.geospatial_codes)")
def _(spark, sf):
    rows = B.obs(spark, sf)
    return Y.sales_orphans(rows, Y.direct_yields(rows)).withColumn("year", F.col("year").cast("bigint"))


@query("D5_gap_fill", "SELECT DISTINCT unique_id AS series_id FROM long l WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.series_id = l.unique_id AND fc.bedrooms <> 'all')")
def _(spark, sf):
    ids = S.long_frame(B.filled_a(spark, sf)).select(F.col("unique_id").alias("series_id")).distinct()
    return joins.gap_fill(ids, B.forecasts(spark, sf).filter(F.col("bedrooms") != "all"))


@query("D6_restrict", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    keys = B.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return joins.restrict(B.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), keys, "c_custkey")


@query("D7_cross_values", "SELECT o_orderpriority, st AS statistic, count(*) AS n FROM orders CROSS JOIN (VALUES ('median'), ('count')) v(st) GROUP BY ALL")
def _(spark, sf):
    rows = joins.cross_values(B.table(spark, sf, "orders").select("o_orderpriority"), "statistic", ["median", "count"])
    return rows.groupBy("o_orderpriority", "statistic").agg(F.count(F.lit(1)).alias("n"))


@query("D7_cross_scalar", "SELECT c_custkey, c_acctbal - m AS over_least FROM customer CROSS JOIN (SELECT min(c_acctbal) AS m FROM customer)")
def _(spark, sf):
    cust = B.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return joins.cross_scalar(cust, cust.agg(F.min("c_acctbal").alias("m"))).select("c_custkey", (F.col("c_acctbal") - F.col("m")).alias("over_least"))


@query("D12_with_exog", "SELECT unique_id, ds, y, index_value AS cpi FROM long JOIN cpi ON time_bucket = ds WHERE region = '1-URGENT' AND unique_id LIKE '%|house|3'")
def _(spark, sf):
    long = S.long_frame(B.obs(spark, sf)).filter(F.col("unique_id").endswith("|house|3"))
    return joins.with_exog(long, filters.index_series(B.cpi(spark, sf), B.INDEX_REGION)).select("unique_id", "ds", "y", "cpi")


@query("D15_resolve_codes", """
WITH l AS (SELECT DISTINCT geospatial, geospatial_codes FROM obs WHERE geospatial_type = 'suburb')
SELECT nm AS geospatial, string_agg(CAST(20000 + k AS VARCHAR), '-' ORDER BY pos) AS geospatial_codes, n
FROM (SELECT 'Supplier#' || lpad(CAST(a AS VARCHAR), 9, '0') || ' - supplier#' || lpad(CAST(b AS VARCHAR), 9, '0') || '-nowhere' AS nm, a, b, n
      FROM (SELECT l_suppkey AS a, l_suppkey // 2 AS b, count(*) AS n FROM lineitem GROUP BY ALL)) x,
     LATERAL (SELECT * FROM (VALUES (0, a), (1, b)) v(pos, k)) GROUP BY nm, n""".replace("WITH l AS (SELECT DISTINCT geospatial, geospatial_codes FROM obs WHERE geospatial_type = 'suburb')\n", ""))
def _(spark, sf):
    li = B.table(spark, sf, "lineitem")
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    b = F.floor(F.col("l_suppkey") / 2)
    label = F.concat(F.lit("Supplier#"), pad(F.col("l_suppkey")), F.lit(" - supplier#"), pad(b), F.lit("-nowhere"))
    lookup = B.regions(spark, sf).select(F.lower("name").alias("name"), "code")
    rows = joins.resolve_codes(li.select(label.alias("geospatial")), lookup, {"supplier#nowhere": "supplier#000000000"})
    return rows.groupBy("geospatial", "geospatial_codes").agg(F.count(F.lit(1)).alias("n"))


@query("D16_future_exog", """
SELECT l.unique_id AS series_id, c.time_bucket AS ds, c.index_value AS cpi FROM (SELECT unique_id, max(ds) - INTERVAL 2 YEAR AS last_ds FROM long GROUP BY 1) l
JOIN cpi c ON c.region = '1-URGENT' AND c.time_bucket > l.last_ds QUALIFY row_number() OVER (PARTITION BY l.unique_id ORDER BY c.time_bucket) <= 4
""".replace("FROM long", "FROM long WHERE unique_id LIKE 'rental|%'"))
def _(spark, sf):
    long = B.rental_long(spark, sf)
    last = long.groupBy(F.col("unique_id").alias("series_id")).agg(F.add_months(F.max("ds"), -24).alias("last_ds"))
    return joins.future_exog(last, filters.index_series(B.cpi(spark, sf), B.INDEX_REGION), 4)


@query("D17_presence", "SELECT * FROM poly")
def _(spark, sf):
    return joins.presence(*B.filled_and_forecasts(spark, sf))


@query("D18_smallest_cluster", """
SELECT geospatial_codes, CAST(year(ds) AS BIGINT) AS year, provenance_cluster_id AS parent_cluster_id, sale_price, round(annual_rent, 6) AS cluster_annual_rent FROM fallback""")
def _(spark, sf):
    rows, hier = B.obs(spark, sf), B.hierarchy(spark, sf)
    orphan = Y.sales_orphans(rows, Y.direct_yields(rows)).select("geospatial_codes", "year", "sale_price")
    best = joins.smallest_cluster(orphan, hier, Y.cluster_rents(rows, hier))
    return best.select("geospatial_codes", F.col("year").cast("bigint").alias("year"), "parent_cluster_id", "sale_price", r6("cluster_annual_rent").alias("cluster_annual_rent"))


MAPPING_SQL = """
WITH g AS (SELECT data_type, geospatial_codes, min(geospatial) AS label FROM obs WHERE geospatial_type = 'suburb' AND statistic = 'median' GROUP BY ALL),
e AS (SELECT data_type, unnest(string_split(geospatial_codes, '-')) AS code, geospatial_codes, label, len(string_split(geospatial_codes, '-')) AS size FROM g),
m AS (SELECT CAST(20000 + s_suppkey AS VARCHAR) AS code, s_name AS name, r.geospatial_codes AS rental_group, r.label AS rental_label, r.size AS rental_size,
  z.geospatial_codes AS sales_group FROM supplier LEFT JOIN e r ON r.data_type = 'rental' AND r.code = CAST(20000 + s_suppkey AS VARCHAR)
  LEFT JOIN e z ON z.data_type = 'sales' AND z.code = CAST(20000 + s_suppkey AS VARCHAR))
"""


def _mapping(spark, sf):
    rows = B.obs(spark, sf)
    return joins.region_mapping(B.regions(spark, sf), aggs.group_labels(rows, "rental"), aggs.group_labels(rows, "sales"))


def _flat_mapping(m):
    return m.select(
        "code", "name", F.col("rental.group_codes").alias("rental_group"), F.col("rental.group_label").alias("rental_label"),
        F.col("rental.group_size").cast("bigint").alias("rental_size"), F.col("sales.group_codes").alias("sales_group"),
    )


@query("D19_region_mapping", MAPPING_SQL + "SELECT * FROM m")
def _(spark, sf):
    return _flat_mapping(_mapping(spark, sf))


@query("C16_lookup_region", MAPPING_SQL + "SELECT * FROM m WHERE code = '20003'")
def _(spark, sf):
    return _flat_mapping(filters.lookup_region(_mapping(spark, sf), "20003"))


# --- 2E ----------------------------------------------------------------------

PAIR_KEYS = ["geospatial_codes", "time_bucket", "dwelling_type", "bedrooms"]


@query("E1_paired_stats", "SELECT geospatial_codes, time_bucket, dwelling_type, bedrooms, med AS median_val, cnt AS count_val FROM rent_cells")
def _(spark, sf):
    return aggs.paired_stats(B.obs(spark, sf), PAIR_KEYS)


@query("E2_weighted_rollup", """
SELECT geospatial_codes, time_bucket, dwelling_type, sum(med * cnt) / sum(cnt) AS value, sum(cnt) AS weight FROM rent_cells WHERE bedrooms <> 'all' GROUP BY ALL""")
def _(spark, sf):
    pairs = aggs.paired_stats(B.obs(spark, sf).filter(F.col("bedrooms") != "all"), PAIR_KEYS)
    return aggs.weighted_rollup(pairs, ["geospatial_codes", "time_bucket", "dwelling_type"], "median_val", "count_val")


@query("E3_annual_mean", """
SELECT geospatial_codes, dwelling_type, bedrooms, year(time_bucket) AS year, avg(value) * 52 AS annual_rent FROM obs
WHERE data_type = 'rental' AND statistic = 'median' GROUP BY ALL""")
def _(spark, sf):
    rows = filters.medians(B.obs(spark, sf)).filter(F.col("data_type") == "rental")
    out = aggs.annual_mean(rows, ["geospatial_codes", "dwelling_type", "bedrooms"], 52, "annual_rent")
    return out.withColumn("year", F.col("year").cast("bigint"))


@query("E4_cluster_median", "SELECT parent_cluster_id, cluster_level, round(rent, 6) AS cluster_annual_rent, n AS n_rental_members FROM cluster_rent")
def _(spark, sf):
    out = Y.cluster_rents(B.obs(spark, sf), B.hierarchy(spark, sf))
    return out.withColumn("cluster_annual_rent", r6("cluster_annual_rent"))


@query("E4_median_by_ranges", """
SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY ALL
UNION ALL SELECT 'all', 'all', median(l_extendedprice), count(*) FROM lineitem""")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    # The coarsest level is one group of all rows.
    both = li.unionByName(li.withColumns({"l_returnflag": F.lit("all"), "l_linestatus": F.lit("all")}))
    out = medians.median(both, ["l_returnflag", "l_linestatus"], "l_extendedprice", held=1000)
    return out.withColumnRenamed("median_val", "price").withColumnRenamed("n_members", "n")


SERIES_KEYS = ["data_type", "geospatial_codes", "dwelling_type", "bedrooms"]


@query("E5_latest", """
SELECT data_type, geospatial_codes, dwelling_type, bedrooms, arg_max(value, time_bucket) AS value, max(time_bucket) AS date
FROM obs WHERE statistic = 'median' GROUP BY ALL""")
def _(spark, sf):
    return aggs.latest(filters.medians(B.obs(spark, sf)), SERIES_KEYS)


@query("E6_group_labels", "SELECT geospatial_codes, min(geospatial) AS label FROM obs WHERE geospatial_type = 'suburb' AND data_type = 'rental' GROUP BY 1")
def _(spark, sf):
    return aggs.group_labels(B.obs(spark, sf), "rental")


@query("E7_source_class", """
SELECT data_type || '|' || geospatial_type || '|' || geospatial_codes || '|' || dwelling_type || '|' || bedrooms AS series_id,
  CASE WHEN bool_and(source_file LIKE 'imputed:%') THEN max(source_file) ELSE 'observed' END AS source_class
FROM filled_a WHERE statistic = 'median' GROUP BY 1""")
def _(spark, sf):
    return aggs.source_class(B.filled_a(spark, sf))


@query("E8_region_series_folded", """
SELECT data_type, geospatial_type, geospatial_codes, dwelling_type, bedrooms, bool_and(source_file LIKE 'imputed:%') OVER w AS imputed,
  CAST(row_number() OVER (w ORDER BY time_bucket) - 1 AS INTEGER) AS pos, time_bucket AS ts, round(value, 6) AS value
FROM filled_a WHERE statistic = 'median' WINDOW w AS (PARTITION BY data_type, geospatial_type, geospatial_codes, dwelling_type, bedrooms)""")
def _(spark, sf):
    folded = aggs.to_series(filters.medians(B.filled_a(spark, sf)), SERIES_DIMS)
    points = folded.select(*SERIES_DIMS, "imputed", F.posexplode("points").alias("pos", "p"))
    return points.select(*SERIES_DIMS, "imputed", "pos", "p.ts", r6("p.value").alias("value"))


def _bitmaps(spark, sf):
    return bitmaps.class_bitmaps(bitmaps.presence_keys(*B.filled_and_forecasts(spark, sf)))


@query("E9_coverage", """
SELECT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, dwelling_type, bedrooms, cls AS source_class,
  count(DISTINCT polygon) AS region_count, count(DISTINCT geospatial_codes) AS row_key_count
FROM (SELECT geospatial_type, dwelling_type, bedrooms, geospatial_codes, unnest(string_split(geospatial_codes, '-')) AS polygon,
        CASE WHEN source_file LIKE 'imputed:%' THEN 'imputed' ELSE 'observed' END AS cls FROM filled WHERE statistic = 'median'
      UNION ALL SELECT geospatial_type, dwelling_type, bedrooms, geospatial_codes, unnest(string_split(geospatial_codes, '-')), 'forecast' FROM fc)
GROUP BY ALL""")
def _(spark, sf):
    return bitmaps.coverage_counts(_bitmaps(spark, sf))


@query("E10_value_domain", "SELECT dwelling_type, bedrooms, min(value) AS value_min, max(value) AS value_max FROM obs WHERE statistic = 'median' AND data_type = 'rental' GROUP BY ALL")
def _(spark, sf):
    rows = filters.medians(B.obs(spark, sf)).filter(F.col("data_type") == "rental")
    return aggs.value_domain(rows, ["dwelling_type", "bedrooms"])


@query("E11_series_extent", "SELECT unique_id, count(*) AS n_obs, max(ds) AS last_ds FROM long GROUP BY 1")
def _(spark, sf):
    return aggs.series_extent(S.long_frame(B.filled_a(spark, sf)))


@query("E12_forecast_folded", """
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos, ds AS ts, round(y_hat, 6) AS y_hat, round(y_hat_hi_95, 6) AS hi95, is_nowcast FROM fc""")
def _(spark, sf):
    folded = aggs.forecast_series(B.forecasts(spark, sf), ["series_id"])
    rows = folded.select("series_id", F.posexplode("forecast").alias("pos", "p"))
    return rows.select("series_id", F.col("pos").cast("bigint").alias("pos"), "p.ts", r6("p.y_hat").alias("y_hat"), r6("p.hi95").alias("hi95"), "p.is_nowcast")


@query("E13_coverage_pivot", """
SELECT tier, dwelling_type, bedrooms, count(*) FILTER (WHERE obs) AS observed, count(*) FILTER (WHERE imp) AS imputed, count(*) FILTER (WHERE fc) AS forecast FROM poly GROUP BY ALL""")
def _(spark, sf):
    return aggs.coverage_pivot(bitmaps.coverage_counts(_bitmaps(spark, sf)))


@query("E14_dedupe", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(spark, sf):
    rows = B.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return aggs.dedupe(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_CELLS = ", ".join(f"('{d}', '{b}')" for d, b in SLICES)


@query("E15_coverage_matrix", f"""
SELECT data_type, geospatial_type, dwelling_type, bedrooms, coalesce(observed, 0) AS observed, coalesce(imputed, 0) AS imputed
FROM (VALUES ('rental'), ('sales')) a(data_type) CROSS JOIN (VALUES ('lga'), ('suburb')) t(geospatial_type) CROSS JOIN (VALUES {_CELLS}) c(dwelling_type, bedrooms)
LEFT JOIN (SELECT data_type, geospatial_type, dwelling_type, bedrooms, count(DISTINCT polygon) FILTER (WHERE source_file NOT LIKE 'imputed:%') AS observed,
    count(DISTINCT polygon) FILTER (WHERE source_file LIKE 'imputed:%') AS imputed
  FROM (SELECT *, unnest(string_split(geospatial_codes, '-')) AS polygon FROM filled WHERE statistic = 'median') GROUP BY ALL)
  USING (data_type, geospatial_type, dwelling_type, bedrooms)""")
def _(spark, sf):
    return aggs.coverage_matrix(B.filled(spark, sf))


@query("E16_mapping_summary", MAPPING_SQL + """
SELECT count(*) AS total, count(rental_group) AS with_rental, count(sales_group) AS with_sales, count(DISTINCT rental_group) AS rental_groups,
  count(DISTINCT sales_group) AS sales_groups, count(DISTINCT rental_group) FILTER (WHERE rental_group LIKE '%-%') AS rental_groups_multi,
  count(DISTINCT sales_group) FILTER (WHERE sales_group LIKE '%-%') AS sales_groups_multi,
  count(*) FILTER (WHERE rental_group IS NULL AND sales_group IS NULL) AS no_data,
  (SELECT count(DISTINCT code) FROM e WHERE code NOT IN (SELECT m2.code FROM m m2)) AS orphan_codes FROM m""")
def _(spark, sf):
    rows = B.obs(spark, sf)
    groups = aggs.group_labels(rows, "rental").unionByName(aggs.group_labels(rows, "sales"))
    return aggs.mapping_summary(_mapping(spark, sf), sets.orphan_codes(groups, B.regions(spark, sf)))


@query("E16_region_totals", """
SELECT tier, total, observed, observed AS imputed_target FROM (SELECT 'sal' AS tier, count(*) AS total FROM supplier UNION ALL SELECT 'lga', count(DISTINCT s_suppkey // 10) FROM supplier)
JOIN (SELECT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, count(DISTINCT code) AS observed
  FROM (SELECT geospatial_type, unnest(string_split(geospatial_codes, '-')) AS code FROM obs) GROUP BY 1) USING (tier)""")
def _(spark, sf):
    cross = B.crosswalk(spark, sf)
    regions = cross.select(F.lit("sal").alias("tier"), F.col("sal_code").alias("code")).unionByName(
        cross.select(F.lit("lga").alias("tier"), F.col("lga_code").alias("code"))
    )
    return aggs.region_totals(regions, aggs.observed_codes(B.obs(spark, sf)))


@query("E19_cluster_stats", """
SELECT parent_cluster_id AS cluster_id, tier, cluster_level, count(*) AS n_nodes, sum(s_acctbal > 0)::BIGINT AS n_nodes_with_rental,
  round(avg(s_nationkey), 6) AS centroid_lat, round(avg(s_suppkey), 6) AS centroid_lon, sum(s_suppkey)::DOUBLE AS area_km2
FROM hier JOIN supplier ON CAST(20000 + s_suppkey AS VARCHAR) = node_id GROUP BY ALL""")
def _(spark, sf):
    nodes = B.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 20000).cast("string").alias("node_id"), F.col("s_nationkey").alias("lat"),
        F.col("s_suppkey").alias("lon"), F.col("s_suppkey").cast("double").alias("area_km2"), (F.col("s_acctbal") > 0).alias("has_rental"),
    )
    out = aggs.cluster_stats(B.hierarchy(spark, sf), nodes)
    return out.withColumns({"centroid_lat": r6("centroid_lat"), "centroid_lon": r6("centroid_lon")})


@query("E21_collisions", """
SELECT code, count(DISTINCT geospatial_codes) AS n_groups FROM (SELECT geospatial_codes, unnest(string_split(geospatial_codes, '-')) AS code FROM obs WHERE geospatial_type = 'suburb')
GROUP BY 1 HAVING count(DISTINCT geospatial_codes) > 1""")
def _(spark, sf):
    rows = B.obs(spark, sf)
    return aggs.collisions(aggs.group_labels(rows, "rental").unionByName(aggs.group_labels(rows, "sales")))


@query("E22_observed_codes", """
SELECT DISTINCT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, unnest(string_split(geospatial_codes, '-')) AS code FROM filled_a WHERE source_file NOT LIKE 'imputed:%' AND statistic = 'median'""")
def _(spark, sf):
    return aggs.observed_codes(B.filled_a(spark, sf))


@query("E23_codes_with_data", "SELECT DISTINCT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, trim(unnest(string_split(geospatial_codes, '-'))) AS code FROM filled_a")
def _(spark, sf):
    return aggs.codes_with_data(B.filled_a(spark, sf))


LATEST_POLY = """
SELECT data_type, dwelling_type, bedrooms, code, arg_max(value, (date, -length(geospatial_codes), geospatial_codes)) AS value, max(date) AS date
FROM (SELECT data_type, dwelling_type, bedrooms, geospatial_codes, unnest(string_split(geospatial_codes, '-')) AS code, value, date
  FROM (SELECT data_type, dwelling_type, bedrooms, geospatial_codes, arg_max(value, time_bucket) AS value, max(time_bucket) AS date
        FROM obs WHERE statistic = 'median' AND geospatial_type = 'suburb' GROUP BY ALL)) GROUP BY ALL"""


def _latest_poly(spark, sf):
    rows = filters.medians(B.obs(spark, sf)).filter(F.col("geospatial_type") == "suburb")
    return aggs.latest_by_polygon(rows, ["data_type", "dwelling_type", "bedrooms"])


@query("E24_latest_by_polygon", LATEST_POLY)
def _(spark, sf):
    return _latest_poly(spark, sf)


# --- 2F, 2G over observations -------------------------------------------------


@query("F1_most_specific", """
SELECT z.geospatial_codes, z.dwelling_type, z.y AS year, arg_min(q.grp, (length(q.grp), q.grp)) AS group_codes FROM sold z
JOIN rent_year q ON q.dwelling_type = z.dwelling_type AND q.y = z.y AND '-' || q.grp || '-' LIKE '%-' || z.geospatial_codes || '-%' GROUP BY ALL""")
def _(spark, sf):
    rows = B.obs(spark, sf)
    groups = aggs.annual_mean(I._rental(rows, "median"), ["geospatial_codes", "dwelling_type"], name="w")
    sold = I._sales_all(rows).select("geospatial_codes", "dwelling_type", "year")
    pairs = joins.containment_join(sold, groups, ["dwelling_type", "year"])
    out = windows.most_specific(pairs, ["geospatial_codes", "dwelling_type", "year"])
    return out.drop("w").withColumn("year", F.col("year").cast("bigint"))


@query("F2_latest_row", """
SELECT geospatial_codes, dwelling_type, bedrooms, max(y) AS year, arg_max(v, y) AS v FROM rent_year WHERE statistic = 'median' AND bedrooms <> 'all' GROUP BY ALL
""".replace("geospatial_codes", "grp AS geospatial_codes"))
def _(spark, sf):
    rows = I._rental(B.obs(spark, sf), "median").filter(F.col("bedrooms") != "all")
    yearly = aggs.annual_mean(rows, ["geospatial_codes", "dwelling_type", "bedrooms"], name="v")
    out = windows.latest_row(yearly, ["geospatial_codes", "dwelling_type", "bedrooms"], "year")
    return out.withColumn("year", F.col("year").cast("bigint"))


@query("F4_horizon_index", """
SELECT unique_id, ds, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS horizon_q FROM naive
QUALIFY horizon_q <= CASE WHEN unique_id LIKE '%house%' THEN 2 ELSE 3 END""".replace("FROM naive", "FROM naive n").replace("QUALIFY horizon_q", "QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds)"))
def _(spark, sf):
    rent, sold = B.rental_long(spark, sf), B.sales_long(spark, sf)
    fc = S.seasonal_naive(rent, 4).unionByName(S.seasonal_naive(sold, 2, 1, 12))
    own = rent.unionByName(sold).select("unique_id").distinct().withColumn("h", F.when(F.col("unique_id").contains("house"), 2).otherwise(3))
    out = windows.horizon_index(fc.select("unique_id", "ds"), own)
    return out.withColumn("horizon_q", F.col("horizon_q").cast("bigint"))


@query("F5_holdout", """
SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 4 AS is_holdout FROM (SELECT unique_id, ds, round(y, 6) AS y FROM long) QUALIFY count(*) OVER (PARTITION BY unique_id) > 4""")
def _(spark, sf):
    return windows.holdout(S.long_frame(B.filled_a(spark, sf)).withColumn("y", r6("y")), 4)


@query("G1_ordered", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return filters.ordered(B.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority", "o_orderkey"])


@query("G2_top1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(spark, sf):
    return windows.top1(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("G3_topk_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 5""")
def _(spark, sf):
    rows = B.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return windows.topk_per_group(rows, ["l_suppkey"], order, 5).drop("l_partkey")


@query("G4_slice_order", """
SELECT geospatial_codes, dwelling_type, bedrooms, row_number() OVER (PARTITION BY geospatial_codes ORDER BY (dwelling_type = 'all' AND bedrooms = 'all') DESC,
  dwelling_type, CASE bedrooms WHEN 'all' THEN -1 ELSE coalesce(TRY_CAST(bedrooms AS DOUBLE), 99) END) - 1 AS pos
FROM (SELECT DISTINCT geospatial_codes, dwelling_type, bedrooms FROM filled_a WHERE data_type = 'rental')""")
def _(spark, sf):
    keys = sets.distinct_keys(B.filled_a(spark, sf).filter(F.col("data_type") == "rental"), ["geospatial_codes", "dwelling_type", "bedrooms"])
    in_order = windows.slice_sorted(keys).withColumn("at", F.monotonically_increasing_id())
    return windows.row_index(in_order, ["geospatial_codes"], ["at"], "pos").drop("at")


@query("G6_palette_slot", """
SELECT geospatial_codes, dwelling_type, bedrooms, (row_number() OVER (PARTITION BY geospatial_codes ORDER BY (dwelling_type = 'all' AND bedrooms = 'all') DESC,
  dwelling_type, CASE bedrooms WHEN 'all' THEN -1 ELSE TRY_CAST(bedrooms AS DOUBLE) END) - 1) % 5 AS slot
FROM (SELECT DISTINCT geospatial_codes, dwelling_type, bedrooms FROM filled_a WHERE data_type = 'rental')""")
def _(spark, sf):
    keys = sets.distinct_keys(B.filled_a(spark, sf).filter(F.col("data_type") == "rental"), ["geospatial_codes", "dwelling_type", "bedrooms"])
    return windows.palette_slot(keys, ["geospatial_codes"], 5).withColumn("slot", F.col("slot").cast("bigint"))


# --- 2H ----------------------------------------------------------------------


@query("H1_union_classified", "SELECT cls, count(*) AS n FROM (SELECT 'obs' AS cls FROM filled_a WHERE statistic = 'median' UNION ALL SELECT 'fc' FROM fc) GROUP BY 1")
def _(spark, sf):
    a = filters.medians(B.filled_a(spark, sf)).select(F.lit("obs").alias("cls"))
    both = sets.union_classified(a, B.forecasts(spark, sf).select(F.lit("fc").alias("cls")))
    return both.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("H2_append_derived", "SELECT " + OBS_ALL.format(v="round(value, 6)") + " FROM filled_a")
def _(spark, sf):
    rows = B.obs(spark, sf)
    return sets.append_derived(rows, I.impute_a(rows)).withColumn("value", r6("value"))


@query("H3_pairwise_diffs", "SELECT * FROM diffs")
def _(spark, sf):
    return sets.pairwise_diffs(joins.presence(*B.filled_and_forecasts(spark, sf)))


@query("H4_orphan_codes", """
SELECT DISTINCT code FROM (SELECT unnest(string_split(geospatial_codes, '-')) AS code FROM obs WHERE geospatial_type = 'suburb')
WHERE code NOT IN (SELECT CAST(20000 + s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 7 <> 0)""")
def _(spark, sf):
    rows = B.obs(spark, sf)
    groups = aggs.group_labels(rows, "rental").unionByName(aggs.group_labels(rows, "sales"))
    known = B.table(spark, sf, "supplier").filter(F.col("s_suppkey") % 7 != 0).select((F.col("s_suppkey") + 20000).cast("string").alias("code"))
    return sets.orphan_codes(groups, known)


@query("H5_flatten_codes", "SELECT DISTINCT dwelling_type, unnest(string_split(geospatial_codes, '-')) AS code FROM obs")
def _(spark, sf):
    return sets.flatten_codes(B.obs(spark, sf), ["dwelling_type"])


@query("H6_distinct_keys", "SELECT DISTINCT geospatial_codes, dwelling_type, bedrooms FROM obs")
def _(spark, sf):
    return sets.distinct_keys(B.obs(spark, sf), ["geospatial_codes", "dwelling_type", "bedrooms"])


# --- 2I ----------------------------------------------------------------------


def _cls(name):
    return "SELECT " + OBS_ALL.format(v="round(value, 6)") + f" FROM {name}"


def _rounded(df):
    return df.withColumn("value", r6("value"))


@query("I1_impute_class_a", _cls("cls_a"))
def _(spark, sf):
    return _rounded(I.impute_a(B.obs(spark, sf)))


@query("I2_impute_class_c", _cls("cls_c"))
def _(spark, sf):
    return _rounded(I.impute_c(B.filled_a(spark, sf)))


@query("I3_impute_class_b", _cls("cls_b"))
def _(spark, sf):
    return _rounded(I.impute_b(B.filled_a(spark, sf)))


@query("I4_impute_class_d", _cls("cls_d"))
def _(spark, sf):
    rows = B.filled_a(spark, sf)
    working = rows.unionByName(I.impute_c(rows)).unionByName(I.impute_b(rows))
    return _rounded(I.impute_d(working, B.crosswalk(spark, sf)))


@query("I5_impute", _cls("filled"))
def _(spark, sf):
    return _rounded(B.filled(spark, sf))


# --- lineage and quality -------------------------------------------------------


def _lineage(spark, sf):
    o = B.obs_table(spark, sf)
    p = cut(joins.presence(B.filled(spark, sf, o), B.forecasts(spark, sf, o)))
    d = sets.pairwise_diffs(p)
    return quality.classify_diffs(p, d), d


def _patterns(spark, sf):
    b = _bitmaps(spark, sf)
    return quality.classify_counts(bitmaps.difference_counts(b), bitmaps.class_sizes(b))


@query("M5_classify_diffs", "SELECT * FROM pattern_rows")
def _(spark, sf):
    return _patterns(spark, sf)


@query("E18_lineage_rollup", """
SELECT pattern, count(DISTINCT (tier, dwelling_type, bedrooms)) AS slices_affected, CAST(sum(n_diff) AS BIGINT) AS appearances, unique_polygons
FROM pattern_rows JOIN (SELECT pattern, count(DISTINCT polygon) AS unique_polygons FROM pattern_rows p JOIN diffs d
  USING (tier, dwelling_type, bedrooms, pair) GROUP BY 1) u USING (pattern) GROUP BY pattern, unique_polygons""")
def _(spark, sf):
    classified, diffs = _lineage(spark, sf)
    return quality.lineage_rollup(classified, diffs).drop("examples")


@query("E18_lineage_examples", """
SELECT pattern, row_number() OVER w - 1 AS pos, dwelling_type, bedrooms, pair, n_diff AS count FROM pattern_rows
WINDOW w AS (PARTITION BY pattern ORDER BY n_diff DESC, dwelling_type, bedrooms, pair) QUALIFY row_number() OVER w <= 5""")
def _(spark, sf):
    rows = quality.lineage_rollup(*_lineage(spark, sf)).select("pattern", F.posexplode("examples").alias("pos", "e"))
    return rows.select("pattern", F.col("pos").cast("bigint").alias("pos"), "e.dwelling_type", "e.bedrooms", "e.pair", "e.count")


@query("E18_pattern_polygons", "SELECT DISTINCT pattern, polygon FROM pattern_rows JOIN diffs USING (tier, dwelling_type, bedrooms, pair)")
def _(spark, sf):
    return quality.pattern_polygons(*_lineage(spark, sf))


@query("M6_absence_reason", """
SELECT tier, dwelling_type, bedrooms, string_split(pair, '_minus_')[2] AS cohort, arg_min(pattern, pair_order) AS reason FROM pattern_rows GROUP BY ALL""")
def _(spark, sf):
    return quality.absence_reason(_patterns(spark, sf))


# --- O1 ------------------------------------------------------------------------


@query("O1_labels", """
SELECT data_type, geospatial_codes, dwelling_type, bedrooms,
  CASE WHEN dwelling_type = 'all' AND bedrooms = 'all' THEN 'All dwellings' WHEN bedrooms = 'all' THEN upper(dwelling_type[1]) || dwelling_type[2:]
       ELSE upper(dwelling_type[1]) || dwelling_type[2:] || ' · ' || bedrooms || ' br' END AS label,
  CASE WHEN source_file LIKE 'imputed:%' THEN 'Imputed · ' || replace(source_file[9:], '_', ' ') ELSE source_file END AS source_label,
  strftime(max(time_bucket), '%b %Y') AS month_label, '$' || format('{:,}', CAST(max(floor(value)) AS BIGINT)) AS money_label
FROM filled_a WHERE statistic = 'median' GROUP BY data_type, geospatial_codes, dwelling_type, bedrooms, source_file""")
def _(spark, sf):
    rows = filters.medians(B.filled_a(spark, sf)).groupBy("data_type", "geospatial_codes", "dwelling_type", "bedrooms", "source_file").agg(
        F.max("time_bucket").alias("d"), F.max(F.floor("value")).alias("v")
    )
    return rows.select(
        "data_type", "geospatial_codes", "dwelling_type", "bedrooms", C.slice_label().alias("label"),
        C.source_label("source_file").alias("source_label"), C.month_year_label("d").alias("month_label"), C.money_label("v").alias("money_label"),
    )
