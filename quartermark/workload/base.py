"""Registry of the checkable queries and the observation-shaped views they run on.

The given tables are TPC-H-like, so the views derive market data from them: every supplier is a
region, ten neighbouring suppliers a parent region, line items are dwellings let or sold. Regions
and rows grow with the data. Values stay on an exact binary grid (medians of whole numbers), so the
Spark result and the SQL oracle agree to the last digit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.plans import impute as I
from quartermark.plans import series as S
from quartermark.plans import yields as Y
from quartermark.schemas import OBS_COLUMNS
from quartermark.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TODAY = date(2002, 6, 30)
INDEX_REGION = "1-URGENT"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- Spark views ------------------------------------------------------------


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the number of their slice: 0 for a missing third, else 1 to 5, 8 more for units."""
    third = F.coalesce((F.col("l_partkey") % 3).cast("int") + 3, F.lit(0))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s"),
        F.floor(F.col("l_suppkey") / 10).cast("bigint").alias("p"),
        (F.col("l_suppkey") % 10).alias("m"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 3).alias("rent"),
        F.floor("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("date").alias("d"),
        F.when(F.col("l_linenumber") % 2 == 0, third).otherwise(third + 8).alias("own"),
    )


#: The slice of all line items.
EVERY = 16


def _with_slices(facts: DataFrame) -> DataFrame:
    """Each line item in its own slice and in that of all."""
    return facts.withColumn("slice", F.explode(F.array("own", F.lit(EVERY))))


def _dwelling() -> Column:
    return F.when(F.col("slice") == EVERY, "all").when(F.col("slice") < 8, "house").otherwise("unit")


def _bedrooms() -> Column:
    third = F.col("slice") % 8
    return F.when(F.col("slice") == EVERY, "all").when(third > 0, (third - 3 + F.when(F.col("slice") < 8, 2).otherwise(1)).cast("string"))


def _medians(rows: DataFrame, region: Column, bucket: Column, value: str) -> DataFrame:
    """r, time_bucket, slice, med, cnt: median and number of the rows of each (region, bucket, slice).

    Groups are small and nearly all values differ, so buffers per group, merged before the shuffle, only
    cost: rows are sorted once, and the middle one looks at its successor. Sorting spills, so a group may
    be large. Keys stay numbers; names are made from them once per group.
    """
    ordered = W.partitionBy("r", "time_bucket", "slice").orderBy(F.col("v").asc_nulls_last())
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = rows.select(region.alias("r"), bucket.alias("time_bucket"), "slice", F.col(value).alias("v")).select(
        "r", "time_bucket", "slice", "v",
        F.lead("v").over(ordered).alias("after"),
        F.row_number().over(ordered).alias("place"),
        F.count("v").over(whole).alias("n"),
        F.count(F.lit(1)).over(whole).alias("cnt"),
    )
    middle = ranked.filter(F.col("place") == F.greatest(F.lit(1), F.expr("(n + 1) div 2")))
    v, after = F.col("v").cast("double"), F.col("after").cast("double")
    med = F.when((F.col("n") > 0) & (F.col("n") % 2 == 0), (v + after) / 2).otherwise(v)
    return middle.select("r", "time_bucket", "slice", med.alias("med"), F.col("cnt").cast("double").alias("cnt"))


def _rent_rows(rented: DataFrame, region: Column, name: Column, codes: Column, tier: str) -> DataFrame:
    """Rows of a tier; `name` and `codes` are made of the region's number `r`."""
    keys = ["geospatial", "geospatial_codes", "time_bucket", "dwelling_type", "bedrooms"]
    agg = _medians(rented, region, F.make_date(F.year("d"), F.quarter("d") * 3, F.lit(1)), "rent").withColumns(
        {"geospatial": name, "geospatial_codes": codes, "dwelling_type": _dwelling(), "bedrooms": _bedrooms()}
    )
    both = F.array(
        F.struct(F.lit("median").alias("statistic"), F.col("med").alias("value")),
        F.struct(F.lit("count").alias("statistic"), F.col("cnt").alias("value")),
    )
    return agg.select(*keys, F.explode(both).alias("v")).select(
        *keys,
        "v.*",
        F.lit(tier).alias("geospatial_type"),
        F.lit("rental").alias("data_type"),
        F.lit("quarterly").alias("data_frequency"),
        F.concat("bedrooms", F.lit(" bedroom "), "dwelling_type").alias("source_sheet"),
    )


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Observations: suburb and parent rental medians with counts, suburb sales medians."""
    base = _facts(spark, sf)
    s, m, r = F.col("s"), F.col("m"), F.col("r")
    code = lambda n: (n + 20000).cast("string")
    # A pair of suburbs has the number of its first; pairs and single suburbs differ in the last digit.
    region = F.when(m < 6, s - m % 2).otherwise(s)
    grouped = r % 10 < 6
    label = F.when(grouped, F.concat(F.lit("group "), code(r))).otherwise(F.concat(F.lit("suburb "), code(r)))
    codes = F.when(grouped, F.concat(code(r), F.lit("-"), code(r + 1))).otherwise(code(r))
    rented = _with_slices(base.filter(m < 8))
    parent_name = F.concat(F.lit("parent "), r.cast("string"))
    parent_code = (r + 90000).cast("string")
    # A dwelling's sales are one group whatever the bedrooms.
    dwelling = F.when(F.col("own") < 8, 0).otherwise(8).alias("slice")
    sales = base.filter((F.col("own") < 8) | (s % 3 != 0)).select("s", "d", "price", dwelling)
    sold = _medians(sales, s, F.make_date(F.year("d"), F.lit(1), F.lit(1)), "price").select(
        F.concat(F.lit("suburb "), code(r)).alias("geospatial"),
        code(r).alias("geospatial_codes"),
        "time_bucket",
        _dwelling().alias("dwelling_type"),
        F.lit("all").alias("bedrooms"),
        F.lit("median").alias("statistic"),
        (F.col("med") * 10).alias("value"),
        F.lit("suburb").alias("geospatial_type"),
        F.lit("sales").alias("data_type"),
        F.lit("annual").alias("data_frequency"),
        F.lit("Table 1").alias("source_sheet"),
    )
    rows = (
        _rent_rows(rented, region, label, codes, "suburb")
        .unionByName(_rent_rows(rented, F.col("p"), parent_name, parent_code, "lga"))
        .unionByName(sold)
    )
    return rows.withColumns(
        {
            "dwelling_class": F.concat("dwelling_type", F.lit("-"), "bedrooms"),
            "source_file": F.lit("vendor.xlsx"),
            "cell": F.lit("A1"),
        }
    ).select(*OBS_COLUMNS)


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    p = F.floor(s / 10)
    return table(spark, sf, "supplier").select(
        (s + 20000).cast("string").alias("sal_code"),
        (p + 90000).cast("string").alias("lga_code"),
        F.concat(F.lit("parent "), p.cast("string")).alias("lga_name"),
    )


def obs_table(spark: SparkSession, sf: str) -> DataFrame:
    """`obs` written once, for queries that read it several times."""
    return cut(obs(spark, sf))


def filled_a(spark: SparkSession, sf: str, o: DataFrame | None = None) -> DataFrame:
    o = obs_table(spark, sf) if o is None else o
    return o.unionByName(I.impute_a(o))


def filled(spark: SparkSession, sf: str, o: DataFrame | None = None) -> DataFrame:
    return I.impute(obs_table(spark, sf) if o is None else o, crosswalk(spark, sf))


def cpi(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly index per order priority."""
    d = F.col("o_orderdate")
    mean = F.sum(F.floor("o_totalprice")) / F.count(F.lit(1))
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("region"),
            F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)).alias("time_bucket"),
        )
        .agg((F.floor(mean / 8) / 16).alias("index_value"))
    )


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    levels = F.array(
        *[
            F.struct(F.lit(lv).alias("cluster_level"), F.floor(s / w).cast("string").alias("c"))
            for lv, w in ((1, 10**15), (2, 50), (5, 10))
        ]
    )
    return table(spark, sf, "supplier").select(
        (s + 20000).cast("string").alias("node_id"), F.explode(levels).alias("l")
    ).select(
        "node_id",
        F.lit("sal").alias("tier"),
        F.concat(F.lit("sal_L"), F.col("l.cluster_level").cast("string"), F.lit("_C"), F.col("l.c")).alias("parent_cluster_id"),
        "l.cluster_level",
        F.lit(0.0).alias("distance"),
    )


def rental_long(spark: SparkSession, sf: str, o: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """Filtering on the market before the ids are built lets the other market's branch drop out."""
    rows = filled_a(spark, sf, o) if first is None else first
    return S.long_frame(rows.filter(F.col("data_type") == "rental"))


def sales_long(spark: SparkSession, sf: str, o: DataFrame | None = None) -> DataFrame:
    return S.long_frame((obs(spark, sf) if o is None else o).filter(F.col("data_type") == "sales"))


def forecasts(spark: SparkSession, sf: str, o: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """Baseline forecasts of every rental series and every sales series, in table form."""
    o = obs_table(spark, sf) if o is None else o
    rental = S.seasonal_naive(rental_long(spark, sf, o, first), 4)
    sales = S.seasonal_naive(sales_long(spark, sf, o), 2, season=1, months=12)
    return S.annotate(rental, TODAY, date(2001, 9, 1), "naive_q", "nowcast_sarima_cpi").unionByName(
        S.annotate(sales, TODAY, None, "naive_annual", "nowcast_sarima_annual")
    )


def filled_and_forecasts(spark: SparkSession, sf: str, o: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`filled` and `forecasts` of the same observations; class A, which both read, is derived once."""
    o = obs_table(spark, sf) if o is None else o
    first = I.first_class(o)
    return I.later_classes(first, crosswalk(spark, sf)), forecasts(spark, sf, o, first)


def yields_view(spark: SparkSession, sf: str, o: DataFrame | None = None) -> DataFrame:
    o = obs_table(spark, sf) if o is None else o
    direct = Y.direct_yields(o)
    return direct.unionByName(Y.fallback_yields(o, direct, hierarchy(spark, sf)))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 20000).cast("string").alias("code"), F.col("s_name").alias("name")
    )


# --- the same views as SQL ---------------------------------------------------

VIEWS: dict[str, str] = {}

VIEWS["facts"] = """
  SELECT l_suppkey AS s, l_suppkey // 10 AS p, l_suppkey % 10 AS m,
         floor(l_extendedprice / l_quantity / 3) AS rent, floor(l_extendedprice) AS price, l_shipdate AS d,
         CASE WHEN g = 1 THEN 'all' WHEN l_linenumber % 2 = 0 THEN 'house' ELSE 'unit' END AS dwelling_type,
         CASE WHEN g = 1 THEN 'all' WHEN l_linenumber % 2 = 0 THEN CAST(2 + l_partkey % 3 AS VARCHAR)
              ELSE CAST(1 + l_partkey % 3 AS VARCHAR) END AS bedrooms
  FROM lineitem CROSS JOIN (VALUES (0), (1)) v(g)"""

VIEWS["rent_cells"] = """
  SELECT CASE WHEN t = 'lga' THEN 'parent ' || CAST(p AS VARCHAR)
              WHEN m < 6 THEN 'group ' || CAST(20000 + s - m % 2 AS VARCHAR)
              ELSE 'suburb ' || CAST(20000 + s AS VARCHAR) END AS geospatial,
         CASE WHEN t = 'lga' THEN CAST(90000 + p AS VARCHAR)
              WHEN m < 6 THEN CAST(20000 + s - m % 2 AS VARCHAR) || '-' || CAST(20001 + s - m % 2 AS VARCHAR)
              ELSE CAST(20000 + s AS VARCHAR) END AS geospatial_codes,
         t AS geospatial_type, make_date(year(d), quarter(d) * 3, 1) AS time_bucket, dwelling_type, bedrooms,
         CAST(median(rent) AS DOUBLE) AS med, CAST(count(*) AS DOUBLE) AS cnt
  FROM facts CROSS JOIN (VALUES ('suburb'), ('lga')) v(t) WHERE m < 8 GROUP BY ALL"""

VIEWS["obs"] = """
  SELECT geospatial, geospatial_codes, geospatial_type, time_bucket, dwelling_type, bedrooms,
         dwelling_type || '-' || bedrooms AS dwelling_class, st AS statistic,
         CASE WHEN st = 'median' THEN med ELSE cnt END AS value, 'rental' AS data_type,
         'quarterly' AS data_frequency, 'vendor.xlsx' AS source_file,
         bedrooms || ' bedroom ' || dwelling_type AS source_sheet, 'A1' AS cell
  FROM rent_cells CROSS JOIN (VALUES ('median'), ('count')) v(st)
  UNION ALL
  SELECT 'suburb ' || CAST(20000 + s AS VARCHAR), CAST(20000 + s AS VARCHAR), 'suburb', make_date(year(d), 1, 1),
         dwelling_type, 'all', dwelling_type || '-all', 'median', CAST(median(price) * 10 AS DOUBLE), 'sales', 'annual',
         'vendor.xlsx', 'Table 1', 'A1'
  FROM facts WHERE dwelling_type = 'house' OR (dwelling_type = 'unit' AND s % 3 <> 0) GROUP BY s, year(d), dwelling_type"""

VIEWS["cls_a"] = """
  SELECT geospatial, geospatial_codes, geospatial_type, time_bucket, dwelling_type, 'all' AS bedrooms,
         dwelling_type || '-all' AS dwelling_class, st AS statistic, CASE WHEN st = 'median' THEN wm ELSE n END AS value,
         'rental' AS data_type, 'quarterly' AS data_frequency,
         'imputed:rollup_rental_dwelling_all' AS source_file, 'class_a' AS source_sheet, '' AS cell
  FROM (SELECT geospatial, geospatial_codes, geospatial_type, time_bucket, dwelling_type, sum(med * cnt) / sum(cnt) AS wm, sum(cnt) AS n
        FROM rent_cells WHERE bedrooms NOT IN ('all', '0') GROUP BY ALL) CROSS JOIN (VALUES ('median'), ('count')) v(st)"""

VIEWS["filled_a"] = "SELECT * FROM obs UNION ALL SELECT * FROM cls_a"

VIEWS["sold"] = """
  SELECT geospatial, geospatial_codes, time_bucket, year(time_bucket) AS y, dwelling_type, value
  FROM obs WHERE data_type = 'sales' AND dwelling_type <> 'all' AND bedrooms = 'all'"""

VIEWS["rent_year"] = """
  SELECT geospatial_codes AS grp, dwelling_type, bedrooms, statistic, year(time_bucket) AS y, avg(value) AS v
  FROM filled_a WHERE data_type = 'rental' AND geospatial_type = 'suburb' AND dwelling_type <> 'all' GROUP BY ALL"""

VIEWS["cls_c"] = """
  SELECT geospatial, geospatial_codes, 'suburb' AS geospatial_type, time_bucket, 'all' AS dwelling_type,
         'all' AS bedrooms, 'all' AS dwelling_class, 'median' AS statistic, sum(value * w) / sum(w) AS value,
         'sales' AS data_type, 'annual' AS data_frequency, 'imputed:rollup_sales_dwelling_all' AS source_file,
         'class_c' AS source_sheet, '' AS cell
  FROM (SELECT z.*, coalesce((SELECT arg_min(v, (length(grp), grp)) FROM rent_year q
                              WHERE q.statistic = 'count' AND q.bedrooms = 'all' AND q.dwelling_type = z.dwelling_type
                                AND q.y = z.y AND '-' || grp || '-' LIKE '%-' || z.geospatial_codes || '-%'), 1.0) AS w
        FROM sold z) GROUP BY geospatial, geospatial_codes, time_bucket"""

VIEWS["ratio"] = """
  SELECT b.grp, b.dwelling_type, b.bedrooms, b.y, b.v / a.v AS ratio
  FROM rent_year b JOIN rent_year a ON a.grp = b.grp AND a.dwelling_type = b.dwelling_type AND a.y = b.y
  WHERE b.statistic = 'median' AND a.statistic = 'median' AND a.bedrooms = 'all' AND b.bedrooms <> 'all' AND a.v > 0"""

VIEWS["cls_b"] = """
  SELECT geospatial, geospatial_codes, 'suburb' AS geospatial_type, time_bucket, dwelling_type, bedrooms,
         dwelling_type || '-' || bedrooms AS dwelling_class, 'median' AS statistic, value,
         'sales' AS data_type, 'annual' AS data_frequency, 'imputed:disagg_sales_bedroom' AS source_file,
         'class_b' AS source_sheet, '' AS cell
  FROM (SELECT z.geospatial, z.geospatial_codes, z.time_bucket, z.dwelling_type, q.bedrooms,
               arg_min(z.value * q.ratio, (length(q.grp), q.grp)) AS value
        FROM sold z JOIN ratio q ON q.dwelling_type = z.dwelling_type AND q.y = z.y
         AND '-' || q.grp || '-' LIKE '%-' || z.geospatial_codes || '-%' GROUP BY ALL)"""

VIEWS["cross_v"] = """
  SELECT CAST(20000 + s_suppkey AS VARCHAR) AS sal_code, CAST(90000 + s_suppkey // 10 AS VARCHAR) AS lga_code,
         'parent ' || CAST(s_suppkey // 10 AS VARCHAR) AS lga_name FROM supplier"""

VIEWS["cls_d"] = """
  SELECT lga_name AS geospatial, lga_code AS geospatial_codes, 'lga' AS geospatial_type, time_bucket, dwelling_type,
         bedrooms, min(dwelling_class) AS dwelling_class, 'median' AS statistic, avg(value) AS value,
         'sales' AS data_type, 'annual' AS data_frequency, 'imputed:rollup_sales_lga' AS source_file,
         'class_d' AS source_sheet, '' AS cell
  FROM (SELECT * FROM obs UNION ALL SELECT * FROM cls_c UNION ALL SELECT * FROM cls_b) w
  JOIN cross_v ON sal_code = geospatial_codes WHERE data_type = 'sales' GROUP BY lga_name, lga_code, time_bucket, w.dwelling_type, w.bedrooms"""

VIEWS["filled"] = """
  SELECT * FROM filled_a UNION ALL SELECT * FROM cls_c UNION ALL SELECT * FROM cls_b UNION ALL SELECT * FROM cls_d"""

VIEWS["cpi"] = """
  SELECT o_orderpriority AS region, make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1) AS time_bucket,
         floor(sum(floor(o_totalprice)) / count(*) / 8) / 16 AS index_value FROM orders GROUP BY ALL"""

VIEWS["hier"] = """
  SELECT CAST(20000 + s_suppkey AS VARCHAR) AS node_id, 'sal' AS tier,
         'sal_L' || CAST(lv AS VARCHAR) || '_C' || CAST(s_suppkey // w AS VARCHAR) AS parent_cluster_id, lv AS cluster_level
  FROM supplier CROSS JOIN (VALUES (1, 1000000000000000), (2, 50), (5, 10)) v(lv, w)"""

VIEWS["long"] = """
  SELECT data_type || '|' || geospatial_type || '|' || geospatial_codes || '|' || dwelling_type || '|' || bedrooms AS unique_id,
         time_bucket AS ds, value AS y FROM filled_a WHERE statistic = 'median'"""

VIEWS["naive"] = """
  SELECT u.unique_id, CAST(last_ds + to_months(CAST(k * mon AS INTEGER)) AS DATE) AS ds, CAST(k AS INTEGER) AS horizon_q, t.y AS y_hat,
         t.y - 1.2815515655446004 * (sigma * sqrt(ceil(k / season))) AS y_hat_lo_80,
         t.y + 1.2815515655446004 * (sigma * sqrt(ceil(k / season))) AS y_hat_hi_80,
         t.y - 1.959963984540054 * (sigma * sqrt(ceil(k / season))) AS y_hat_lo_95,
         t.y + 1.959963984540054 * (sigma * sqrt(ceil(k / season))) AS y_hat_hi_95
  FROM (SELECT unique_id, season, mon, max(ds) AS last_ds, sqrt(sum(dd * dd) / count(dd)) AS sigma, unnest(range(1, h + 1)) AS k
        FROM (SELECT *, CASE WHEN unique_id LIKE 'rental|%' THEN 4 ELSE 1 END AS season,
                     CASE WHEN unique_id LIKE 'rental|%' THEN 3 ELSE 12 END AS mon,
                     CASE WHEN unique_id LIKE 'rental|%' THEN 4 ELSE 2 END AS h,
                     y - lag(y, CASE WHEN unique_id LIKE 'rental|%' THEN 4 ELSE 1 END) OVER (PARTITION BY unique_id ORDER BY ds) AS dd
              FROM long) GROUP BY unique_id, season, mon, h HAVING count(dd) > 0) u
  JOIN (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM long) t
    ON t.unique_id = u.unique_id AND t.back = season - (k - 1) % season"""

VIEWS["fc"] = """
  SELECT unique_id AS series_id, split_part(unique_id, '|', 1) AS data_type, split_part(unique_id, '|', 2) AS geospatial_type,
         split_part(unique_id, '|', 3) AS geospatial_codes, split_part(unique_id, '|', 4) AS dwelling_type,
         split_part(unique_id, '|', 5) AS bedrooms, ds, horizon_q, ds <= DATE '2002-06-30' AS is_nowcast,
         unique_id LIKE 'rental|%' AND ds > DATE '2001-09-01' AS cpi_is_projected,
         y_hat, y_hat_lo_80, y_hat_hi_80, y_hat_lo_95, y_hat_hi_95,
         CASE WHEN unique_id LIKE 'rental|%' THEN 'naive_q' ELSE 'naive_annual' END AS model, DATE '2002-06-30' AS fit_date,
         CASE WHEN unique_id LIKE 'rental|%' THEN 'nowcast_sarima_cpi' ELSE 'nowcast_sarima_annual' END AS imputation_method,
         CAST(NULL AS VARCHAR) AS provenance_cluster_id
  FROM naive"""

VIEWS["direct"] = """
  SELECT z.geospatial_codes, z.dwelling_type, make_date(z.y, 12, 1) AS ds, arg_min(r.v, (length(r.grp), r.grp)) AS annual_rent,
         z.value AS sale_price, 'suburb_direct' AS source, CAST(NULL AS VARCHAR) AS provenance_cluster_id
  FROM sold z JOIN (SELECT geospatial_codes AS grp, dwelling_type, year(time_bucket) AS y, avg(value) * 52 AS v FROM obs
                    WHERE data_type = 'rental' AND geospatial_type = 'suburb' AND statistic = 'median'
                      AND dwelling_type <> 'all' GROUP BY ALL) r
    ON r.dwelling_type = z.dwelling_type AND r.y = z.y AND '-' || r.grp || '-' LIKE '%-' || z.geospatial_codes || '-%'
  GROUP BY z.geospatial_codes, z.dwelling_type, z.y, z.value"""

VIEWS["overall"] = """
  SELECT geospatial_type, geospatial_codes, avg(value) * 52 AS rent FROM obs
  WHERE data_type = 'rental' AND statistic = 'median' AND dwelling_type = 'all' GROUP BY ALL"""

VIEWS["cluster_rent"] = """
  SELECT parent_cluster_id, cluster_level, median(rent) AS rent, count(*) AS n FROM hier
  JOIN overall ON node_id = geospatial_codes GROUP BY ALL HAVING count(*) >= 3"""

VIEWS["fallback"] = """
  SELECT geospatial_codes, 'all' AS dwelling_type, make_date(b.y, 12, 1) AS ds, b.rent AS annual_rent, b.value AS sale_price,
         'cluster_fallback' AS source, b.parent_cluster_id AS provenance_cluster_id
  FROM (SELECT z.geospatial_codes, max({'l': h.cluster_level, 'y': z.y, 'value': z.value, 'parent_cluster_id': h.parent_cluster_id, 'rent': c.rent}) AS b
        FROM sold z JOIN hier h ON h.node_id = z.geospatial_codes JOIN cluster_rent c USING (parent_cluster_id, cluster_level)
        WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.geospatial_codes = z.geospatial_codes) GROUP BY z.geospatial_codes)"""

VIEWS["yld"] = """
  SELECT *, annual_rent / sale_price AS gross_yield FROM (SELECT * FROM direct UNION ALL SELECT * FROM fallback)"""

VIEWS["poly"] = """
  SELECT CASE geospatial_type WHEN 'suburb' THEN 'sal' ELSE 'lga' END AS tier, dwelling_type, bedrooms, polygon,
         bool_or(cls = 'observed') AS obs, bool_or(cls = 'imputed') AS imp, bool_or(cls = 'forecast') AS fc
  FROM (SELECT geospatial_type, dwelling_type, bedrooms, unnest(string_split(geospatial_codes, '-')) AS polygon,
               CASE WHEN source_file LIKE 'imputed:%' THEN 'imputed' ELSE 'observed' END AS cls
        FROM filled WHERE statistic = 'median'
        UNION ALL
        SELECT geospatial_type, dwelling_type, bedrooms, unnest(string_split(geospatial_codes, '-')), 'forecast' FROM fc)
  GROUP BY ALL"""

VIEWS["diffs"] = """
  SELECT tier, dwelling_type, bedrooms, polygon, pair, po AS pair_order
  FROM poly CROSS JOIN (VALUES (0, 'obs_minus_imp'), (1, 'imp_minus_obs'), (2, 'obs_minus_fc'), (3, 'fc_minus_obs'),
                               (4, 'imp_minus_fc'), (5, 'fc_minus_imp')) v(po, pair)
  WHERE CASE po WHEN 0 THEN obs AND NOT imp WHEN 1 THEN imp AND NOT obs WHEN 2 THEN obs AND NOT fc
                WHEN 3 THEN fc AND NOT obs WHEN 4 THEN imp AND NOT fc ELSE fc AND NOT imp END"""

VIEWS["pattern_rows"] = """
  SELECT d.*, n_obs, n_imp, n_fc, CASE WHEN pair = 'imp_minus_obs' THEN CASE WHEN n_obs = 0 THEN 'P1_VENDOR_GAP' WHEN n_diff <= 2 THEN 'P5_MULTI_SAL_GROUP_EDGE_CASE' ELSE 'P4_CROSS_TIER_IMPUTE_EXPANSION' END
    WHEN pair = 'obs_minus_imp' THEN CASE WHEN n_diff <= 2 THEN 'P5_MULTI_SAL_GROUP_EDGE_CASE' ELSE 'P2_OBSERVED_NOT_REIMPUTED' END
    WHEN pair LIKE '%minus_fc' THEN CASE WHEN n_diff <= 2 THEN 'P5_MULTI_SAL_GROUP_EDGE_CASE' ELSE 'P3_BELOW_SARIMAX_MIN_OBS' END
    ELSE CASE WHEN n_obs = 0 OR n_imp = 0 THEN 'P1_VENDOR_GAP' WHEN n_diff <= 2 THEN 'P5_MULTI_SAL_GROUP_EDGE_CASE' ELSE 'P4_CROSS_TIER_IMPUTE_EXPANSION' END END AS pattern
  FROM (SELECT tier, dwelling_type, bedrooms, pair, pair_order, count(*) AS n_diff FROM diffs GROUP BY ALL) d
  JOIN (SELECT tier, dwelling_type, bedrooms, count(*) FILTER (WHERE obs) AS n_obs, count(*) FILTER (WHERE imp) AS n_imp,
               count(*) FILTER (WHERE fc) AS n_fc FROM poly GROUP BY ALL) USING (tier, dwelling_type, bedrooms)"""


def with_views(sql: str) -> str:
    """Prefix a query with the views it needs, in dependency order."""
    import re

    def mentions(text: str) -> list[str]:
        words = set(re.findall(r"\b(?:FROM|JOIN|from|join)\s+(\w+)", text))
        return [v for v in VIEWS if v in words]

    needed: list[str] = []

    def visit(name: str) -> None:
        for dep in mentions(VIEWS[name]):
            if dep not in needed:
                visit(dep)
        if name not in needed:
            needed.append(name)

    for name in mentions(sql):
        visit(name)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
