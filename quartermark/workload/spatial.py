"""Queries of 2A, 2B and 2L: files, features, polygons, cells, tiles.

Every supplier owns one square of a 1/128-degree grid, ten in a row form a parent region, so shapes
grow with the data and their corners are exact binary numbers.
"""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.functions import columns as C
from quartermark.functions import geometry as G
from quartermark.operators import aggs, filters, joins
from quartermark.plans import impute as I
from quartermark.plans import spatial as P
from quartermark.schemas import schema
from quartermark.sources import readers, sinks
from quartermark.workload import base as B
from quartermark.workload import cube
from quartermark.workload.base import VIEWS, query, r6

STEP = 128.0


def _corner(s):
    x = s % 20 + 20 * (F.floor(s / 400) % 50)
    y = F.floor(s / 20) % 20 + 20 * F.floor(s / 20000)
    return 144 + x / STEP, -38 + y / STEP


def _rect(x0, y0, x1, y1):
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    return F.array(F.array(ring))


def squares(spark, sf):
    s = F.col("s_suppkey")
    x, y = _corner(s)
    return B.table(spark, sf, "supplier").select(
        (s + 20000).cast("string").alias("code"), F.col("s_name").alias("name"), F.floor(s / 10).alias("p"),
        _rect(x, y, x + 1 / STEP, y + 1 / STEP).alias("geom"),
    )


def parents(spark, sf):
    p = F.col("p")
    x, y = _corner(p * 10)
    rows = B.table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 10).alias("p")).distinct()
    return rows.select(
        (p + 90000).cast("string").alias("code"), F.concat(F.lit("parent "), p.cast("string")).alias("name"),
        _rect(x, y, x + 10 / STEP, y + 1 / STEP).alias("geom"),
    )


VIEWS["sq"] = """
  SELECT s_suppkey AS s, CAST(20000 + s_suppkey AS VARCHAR) AS code, s_name AS name, s_suppkey // 10 AS p,
         s_suppkey % 20 + 20 * (s_suppkey // 400 % 50) AS gx, s_suppkey // 20 % 20 + 20 * (s_suppkey // 20000) AS gy,
         144 + (s_suppkey % 20 + 20 * (s_suppkey // 400 % 50)) / 128.0::DOUBLE AS x0,
         -38 + (s_suppkey // 20 % 20 + 20 * (s_suppkey // 20000)) / 128.0::DOUBLE AS y0 FROM supplier"""
VIEWS["merc"] = """
  SELECT code, name, p, x0, y0, radians(x0) * 6378137.0 AS mx0, radians(x0 + 1 / 128.0::DOUBLE) * 6378137.0 AS mx1,
         ln(tan(radians(y0) / 2 + pi() / 4)) * 6378137.0 AS my0, ln(tan(radians(y0 + 1 / 128.0::DOUBLE) / 2 + pi() / 4)) * 6378137.0 AS my1 FROM sq"""
RES = 12
VIEWS["hexes"] = """
  SELECT p, code, 'h12:' || CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS cell
  FROM (SELECT *, unnest(range(CAST(floor(mx0 / dx - r / 2) AS BIGINT) - 1, CAST(ceil(mx1 / dx - r / 2) AS BIGINT) + 2)) AS q
        FROM (SELECT *, unnest(range(CAST(ceil(my0 / dy) AS BIGINT), CAST(floor(my1 / dy) AS BIGINT) + 1)) AS r
              FROM (SELECT *, 1000000.0 / 4096 * sqrt(3::DOUBLE) AS dx, 1000000.0 / 4096 * 1.5 AS dy FROM merc)))
  WHERE (q + r / 2) * dx >= mx0 AND (q + r / 2) * dx < mx1 AND r * dy >= my0 AND r * dy < my1"""
VIEWS["tiles"] = """
  SELECT code, name, x0, y0, z, tx, unnest(range(CAST(ty0 AS BIGINT), CAST(ty1 AS BIGINT) + 1)) AS ty
  FROM (SELECT *, unnest(range(CAST(floor((x0 + 180) / 360 * n) AS BIGINT), CAST(floor((x0 + 1 / 128.0::DOUBLE - 1e-11 + 180) / 360 * n) AS BIGINT) + 1)) AS tx,
          floor((0.5 - ln((1 + sin(radians(y0 + 1 / 128.0::DOUBLE))) / (1 - sin(radians(y0 + 1 / 128.0::DOUBLE)))) / (4 * pi())) * n) AS ty0,
          floor((0.5 - ln((1 + sin(radians(y0 + 1e-11))) / (1 - sin(radians(y0 + 1e-11)))) / (4 * pi())) * n) AS ty1
        FROM (SELECT *, pow(2.0::DOUBLE, z) AS n FROM sq CROSS JOIN (VALUES (9), (10), (11), (12), (13)) v(z)))"""

# --- 2A ------------------------------------------------------------------------


@query("A1_scan_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, sf):
    return readers.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("A2_scan_key_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(spark, sf):
    hit = readers.scan_filtered(spark, f"{sf}/orders.parquet", "o_orderpriority", ["1-URGENT", "5-LOW"])
    return hit.select("o_orderkey", "o_totalprice")


@query("A2_scan_key_table", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(spark, sf):
    keys = B.table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("l_suppkey"))
    hit = readers.scan_filtered(spark, f"{sf}/lineitem.parquet", "l_suppkey", keys)
    return hit.select("l_orderkey", "l_linenumber", "l_suppkey")


PROPS = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType())])
FEATURE_SQL = "SELECT code, name, CAST(5 AS BIGINT) AS n_vertices, round(x0, 6) AS minx, round(y0, 6) AS miny FROM sq"


@query("A3_feature_scan", FEATURE_SQL)
def _(spark, sf):
    path = sinks.write_features(squares(spark, sf), sinks.scratch_path(spark, "features"), ["code", "name"])
    rows = readers.scan_features(spark, path, PROPS, coordinates="array<array<array<array<double>>>>")
    box = G.bbox("geom")
    return rows.select("code", "name", F.size(G.vertices("geom")).cast("bigint").alias("n_vertices"), box["minx"].alias("minx"), box["miny"].alias("miny"))


@query("A3_feature_pieces", FEATURE_SQL)
def _(spark, sf):
    # One document per run of codes, its features in one list.
    lines = sinks.to_features(squares(spark, sf), ["code", "name"]).withColumn("file", F.pmod(F.xxhash64("value"), F.lit(8)))
    docs = lines.groupBy("file").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.concat_ws(", ", F.collect_list("value")), F.lit("]}")).alias("value"))
    path = sinks.scratch_path(spark, "collections")
    docs.select("value").write.text(path)
    rows = readers.scan_features(spark, path, PROPS, layout="pieces", coordinates="array<array<array<array<double>>>>")
    box = G.bbox("geom")
    return rows.select("code", "name", F.size(G.vertices("geom")).cast("bigint").alias("n_vertices"), box["minx"].alias("minx"), box["miny"].alias("miny"))


@query("A4_scan_folder", """
SELECT 'nation' AS level, count(*) AS n, count(n_name) AS named FROM nation UNION ALL SELECT 'region', count(*), 0 FROM region
UNION ALL SELECT 'supplier', count(*), 0 FROM supplier""")
def _(spark, sf):
    rows = readers.scan_dir(spark, [f"{sf}/{t}.parquet" for t in ("nation", "region", "supplier")])
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count("n_name").alias("named"))


def _grid(spark, sf):
    """Sheets as a vendor ships them: one row per region, count and median columns per quarter."""
    li = B.table(spark, sf, "lineitem")
    d = F.col("l_shipdate")
    first, last = li.agg(F.min(F.year(d)), F.max(F.year(d))).first()
    n = 4 * (last - first + 1)
    q = (F.year(d) - first) * 4 + F.quarter(d) - 1
    cells = li.groupBy(F.col("l_suppkey").alias("s"), q.alias("q")).agg(
        F.count(F.lit(1)).cast("string").alias("n"), F.median(F.floor("l_extendedprice")).cast("string").alias("m")
    )
    by_q = cells.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("q", F.array("n", "m")))).alias("c"))
    quarters = F.sequence(F.lit(0), F.lit(n - 1))
    blank = F.array(F.lit("-"), F.lit(""))
    values = F.flatten(F.transform(quarters, lambda i: F.coalesce(F.element_at("c", i), blank)))
    rows = by_q.select(
        (F.col("s") + 4).cast("int").alias("row_no"),
        F.concat(F.array(F.lit(""), F.concat(F.lit("suburb "), F.col("s").cast("string"))), values).alias("cells"),
    )
    label = lambda i: F.date_format(F.make_date(first + F.floor(i / 4).cast("int"), (i % 4) * 3 + 3, F.lit(1)), "MMM yyyy")
    head = li.limit(1).select(
        F.lit(2).alias("row_no"),
        F.concat(F.array(F.lit(""), F.lit("")), F.flatten(F.transform(quarters, lambda i: F.array(label(i), label(i))))).alias("cells"),
    )
    total = li.limit(1).select(F.lit(3).alias("row_no"), F.concat(F.array(F.lit(""), F.lit("Group Total")), F.array_repeat(F.lit("1"), 2 * n)).alias("cells"))
    grid = head.unionByName(total).unionByName(rows).withColumns({"source_file": F.lit("rents.xlsx"), "source_sheet": F.lit("All properties")})
    mapping = spark.createDataFrame(
        [("rents.xlsx", "All properties", 2, 3, 2 * n + 2, 2, 3, 2**31 - 1, ["count", "median"], "MMM yyyy", "all", "all", "suburb", "rental", "quarterly")],
        "source_file string, source_sheet string, header_row int, first_col int, last_col int, geo_col int, first_row int, last_row int, "
        "statistics array<string>, time_format string, dwelling_type string, bedrooms string, geospatial_type string, data_type string, data_frequency string",
    )
    return grid, mapping


@query("A5_grid_to_long", """
SELECT 'suburb ' || CAST(s AS VARCHAR) AS geospatial, b AS time_bucket, st AS statistic, CASE WHEN st = 'count' THEN n ELSE m END AS value,
  CASE WHEN k <= 26 THEN chr(CAST(64 + k AS INTEGER)) ELSE chr(CAST(64 + (k - 1) // 26 AS INTEGER)) || chr(CAST(65 + (k - 1) % 26 AS INTEGER)) END || CAST(s + 4 AS VARCHAR) AS cell
FROM (SELECT *, 3 + 2 * q + CASE WHEN st = 'count' THEN 0 ELSE 1 END AS k FROM (SELECT l_suppkey AS s, (year(l_shipdate) - (SELECT min(year(l_shipdate)) FROM lineitem)) * 4 + quarter(l_shipdate) - 1 AS q,
    make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1) AS b, CAST(count(*) AS DOUBLE) AS n, CAST(median(floor(l_extendedprice)) AS DOUBLE) AS m FROM lineitem GROUP BY ALL)
  CROSS JOIN (VALUES ('count'), ('median')) v(st))""")
def _(spark, sf):
    return readers.grid_to_long(*_grid(spark, sf)).select("geospatial", "time_bucket", "statistic", "value", "cell")


@query("A6_sdmx_series", "SELECT region, time_bucket, index_value FROM cpi WHERE quarter(time_bucket) <> 2")
def _(spark, sf):
    idx = B.cpi(spark, sf)
    label = F.concat(F.year("time_bucket").cast("string"), F.lit("-Q"), F.quarter("time_bucket").cast("string"))
    folded = idx.groupBy("region").agg(
        F.array_sort(F.collect_list(F.struct("time_bucket", label.alias("id"), F.when(F.quarter("time_bucket") != 2, F.col("index_value")).alias("v")))).alias("p")
    )
    obs = F.map_from_entries(F.transform("p", lambda e, i: F.struct(i.cast("string"), F.array(e["v"]))))
    series = F.create_map(F.lit("0:0:0:0:0"), F.struct(obs.alias("observations")))
    times = F.struct(F.transform("p", lambda e: F.struct(e["id"].alias("id"))).alias("values"))
    payload = F.struct(
        F.struct(
            F.array(F.struct(series.alias("series"))).alias("dataSets"),
            F.struct(F.struct(F.array(times).alias("observation")).alias("dimensions")).alias("structure"),
        ).alias("data")
    )
    docs = folded.select("region", F.to_json(payload, {"ignoreNullFields": "false"}).alias("doc"))
    return readers.scan_sdmx(docs, "doc")


@query("A7_map_document", "SELECT event_id, 'k' AS key, props->>'$.k' AS value FROM events")
def _(spark, sf):
    return readers.scan_map_json(B.table(spark, sf, "events").select("event_id", "props"), "props", ["event_id"])


@query("A8_inventory", """
SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'qm_absent', 0""")
def _(spark, sf):
    for t in ("lineitem", "orders"):
        B.table(spark, sf, t).createOrReplaceTempView(f"qm_{t}")
    out = readers.inventory(spark, ["qm_lineitem", "qm_orders", "qm_absent"])
    return out.withColumn("table_name", F.when(F.col("table_name") == "qm_absent", "qm_absent").otherwise(F.replace("table_name", F.lit("qm_"), F.lit(""))))


@query("A9_optional_table", "SELECT code, CAST(0 AS BIGINT) AS n_with_rental FROM sq")
def _(spark, sf):
    rented = readers.table_or_empty(spark, "qm_no_such_table", schema("rental_sales"))
    keys = rented.select(F.col("geospatial_codes").alias("code")).distinct().withColumn("hit", F.lit(1))
    return squares(spark, sf).select("code").join(keys, "code", "left").groupBy("code").agg(F.count("hit").alias("n_with_rental"))


# --- 2B ------------------------------------------------------------------------

PLAIN = "SELECT c_custkey, c_name, c_acctbal FROM customer"


@query("B1_parquet_checkpoint", PLAIN)
def _(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return spark.read.parquet(sinks.write_parquet(rows, sinks.scratch_path(spark, "customers")))


@query("B2_replace_table", PLAIN + " WHERE c_acctbal > 0")
def _(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = sinks.scratch_path(spark, "table")
    name = "qm_" + path.rsplit("-", 1)[1]
    sinks.replace_table(rows, name, path)
    return sinks.replace_table(rows.filter(F.col("c_acctbal") > 0), name, path)


@query("B3_replace_slice", """
SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS v FROM orders
WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0""")
def _(spark, sf):
    rows = B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lit(0).alias("v"))
    path = sinks.replace_slice(rows, sinks.scratch_path(spark, "slices"), ["o_orderpriority"])
    fresh = rows.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 2 == 0)).withColumn("v", F.lit(1))
    return spark.read.parquet(sinks.replace_slice(fresh, path, ["o_orderpriority"]))


@query("B4_conform", "SELECT * FROM cross_v")
def _(spark, sf):
    return sinks.conform(B.crosswalk(spark, sf).withColumn("extra", F.lit(1)), schema("crosswalk"))


@query("B5_idempotent_rewrite", "SELECT geospatial_codes, time_bucket, dwelling_type, bedrooms, statistic, data_type, round(value, 6) AS value FROM filled")
def _(spark, sf):
    once = B.filled(spark, sf)
    path = sinks.write_parquet(once, sinks.scratch_path(spark, "filled"))
    twice = I.impute(spark.read.parquet(path), B.crosswalk(spark, sf))
    return twice.select("geospatial_codes", "time_bucket", "dwelling_type", "bedrooms", "statistic", "data_type", r6("value").alias("value"))


@query("B6_compact", PLAIN)
def _(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    src = sinks.write_parquet(rows.repartition(16), sinks.scratch_path(spark, "many"))
    return spark.read.parquet(sinks.compact(spark, src, sinks.scratch_path(spark, "few"), 2))


@query("B5_rewrite_in_place", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS price, false AS derived FROM orders
UNION ALL SELECT NULL, o_custkey, round(sum(o_totalprice), 6), true FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    def with_totals(rows):
        direct = rows.filter(~F.col("derived"))
        totals = direct.groupBy("o_custkey").agg(F.sum("price").alias("price"))
        return direct.unionByName(totals.withColumn("derived", F.lit(True)), allowMissingColumns=True)

    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.lit(False).alias("derived"))
    path = sinks.scratch_path(spark, "orders")
    sinks.publish(orders, path)
    for _ in range(2):
        sinks.rewrite(spark, path, with_totals)
    return sinks.read_current(spark, path).withColumn("price", r6("price"))


@query("B6_compact_in_place", PLAIN)
def _(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = sinks.scratch_path(spark, "customers")
    sinks.publish(rows.repartition(16), path)
    sinks.compact_current(spark, path, 2)
    sinks.expire(spark, path, keep=1)
    return sinks.read_current(spark, path)


@query("B7_map_document", "SELECT code AS key, name AS value FROM sq")
def _(spark, sf):
    docs = sinks.to_map_doc(squares(spark, sf), "code", "name", shards=4)
    return readers.scan_map_json(docs, "doc")


@query("B8_features", """
SELECT code, round(x0, 6) AS x, round(y0, 6) AS y, 'Feature' AS kind FROM sq""")
def _(spark, sf):
    doc = sinks.to_features(squares(spark, sf), ["code", "name"], 6)
    num = lambda p: F.get_json_object("value", p).cast("double")
    return doc.select(
        F.get_json_object("value", "$.properties.code").alias("code"), num("$.geometry.coordinates[0][0][0][0]").alias("x"),
        num("$.geometry.coordinates[0][0][0][1]").alias("y"), F.get_json_object("value", "$.type").alias("kind"),
    )


@query("B9_run_record", "SELECT 42 AS seed, DATE '2002-06-30' AS today, max(time_bucket) AS index_max FROM cpi")
def _(spark, sf):
    last = B.cpi(spark, sf).agg(F.max("time_bucket")).first()[0]
    record = sinks.write_meta(spark, sinks.scratch_path(spark, "meta"), 42, B.TODAY, last, {"spark": spark.version})
    return record.select("seed", "today", "index_max")


def _tiles(spark, sf):
    return P.tile_layer(squares(spark, sf), "sal", 9, 13, ["code", "name"])


@query("B10_tile_manifest", """
SELECT 'sal' AS layer, min(z) AS min_zoom, max(z) AS max_zoom, count(DISTINCT (z, tx, ty)) AS n_tiles, min(x0) AS west, min(y0) AS south,
  max(x0) + 1 / 128.0::DOUBLE AS east, max(y0) + 1 / 128.0::DOUBLE AS north FROM tiles""")
def _(spark, sf):
    return sinks.tile_manifest(_tiles(spark, sf))


@query("B10_tile_keys", "SELECT DISTINCT 'sal' AS layer, CAST(z AS VARCHAR) || '/' || CAST(tx AS VARCHAR) || '/' || CAST(ty AS VARCHAR) AS tile FROM tiles")
def _(spark, sf):
    return sinks.tile_keys(_tiles(spark, sf))


# --- geometry --------------------------------------------------------------------


@query("C13_drop_empty_geom", "SELECT code FROM sq WHERE s % 4 > 1")
def _(spark, sf):
    rows = squares(spark, sf)
    s = F.col("code").cast("int") % 4
    gone = F.when(s > 1, F.col("geom")).when(s == 1, F.slice("geom", 1, 0))
    return filters.drop_empty_geom(rows.withColumn("geom", gone)).select("code")


@query("D8_within_join", "SELECT code AS sal_code, CAST(90000 + p AS VARCHAR) AS lga_code, 'parent ' || CAST(p AS VARCHAR) AS lga_name FROM sq")
def _(spark, sf):
    return P.crosswalk(squares(spark, sf), parents(spark, sf))


@query("D9_touching_pairs", """
SELECT a.code AS src, b.code AS dst FROM sq a JOIN sq b ON a.code < b.code AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1""")
def _(spark, sf):
    return P.touching_pairs(squares(spark, sf))


@query("D10_tile_candidates", "SELECT code, CAST(z AS INTEGER) AS z, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty FROM tiles")
def _(spark, sf):
    return P.tile_candidates(squares(spark, sf), 9, 13).select("code", "z", "tx", "ty")


@query("D14_cell_values", f"""
SELECT h.cell, h.code, l.value, l.date, coalesce(n.name, h.code) AS name FROM (SELECT cell, min(code) AS code FROM hexes GROUP BY 1) h
JOIN (SELECT * FROM ({cube.LATEST_POLY}) WHERE data_type = 'rental' AND dwelling_type = 'all') l ON l.code = h.code
LEFT JOIN (SELECT code, name FROM sq WHERE s % 5 <> 0) n ON n.code = h.code WHERE l.value BETWEEN 400 AND 600""")
def _(spark, sf):
    latest = cube._latest_poly(spark, sf).filter((F.col("data_type") == "rental") & (F.col("dwelling_type") == "all"))
    names = squares(spark, sf).filter(F.col("code").cast("int") % 5 != 0).select("code", "name")
    cells = P.cell_cover(squares(spark, sf), RES)
    return joins.cell_values(cells, latest.select("code", "value", "date"), names, 400, 600)


@query("E20_total_bounds", "SELECT min(x0) AS west, min(y0) AS south, max(x0) + 1 / 128.0::DOUBLE AS east, max(y0) + 1 / 128.0::DOUBLE AS north FROM sq")
def _(spark, sf):
    return P.total_bounds(squares(spark, sf))


@query("L1_reproject", "SELECT code, round(mx0, 3) AS x, round(my0, 3) AS y FROM merc")
def _(spark, sf):
    g = P.reproject(squares(spark, sf), 4326, 3857)
    v = F.get(G.vertices("geom"), 0)
    return g.select("code", r6(v["x"], 3).alias("x"), r6(v["y"], 3).alias("y"))


@query("L2_centroid_area", """
SELECT code, round(x0 + 1 / 256.0::DOUBLE, 9) AS cx, round(y0 + 1 / 256.0::DOUBLE, 9) AS cy, 1 / 16384.0::DOUBLE AS area FROM sq""")
def _(spark, sf):
    out = P.centroid_area(squares(spark, sf)).select("code", "cx", "cy", "area")
    return out.withColumns({"cx": r6("cx", 9), "cy": r6("cy", 9)})


@query("L2_parent_area", """
SELECT CAST(90000 + p AS VARCHAR) AS code, round((max(mx0) + (any_value(mx1) - any_value(mx0)) - min(mx0)) * (any_value(my1) - any_value(my0)) / 1e6, 3) AS area_km2 FROM merc
GROUP BY p HAVING count(*) = 10""")
def _(spark, sf):
    out = P.centroid_area(P.reproject(parents(spark, sf), 4326, 3857))
    return out.select("code", r6(F.col("area") / 1e6, 3).alias("area_km2"))


@query("L3_interior_point", "SELECT code, x0 + 1 / 256.0::DOUBLE AS x, y0 + 1 / 256.0::DOUBLE AS y FROM sq")
def _(spark, sf):
    return P.interior_points(squares(spark, sf)).select("code", "x", "y")


@query("L4_cell_cover", "SELECT cell, min(code) AS code FROM hexes GROUP BY 1")
def _(spark, sf):
    return P.cell_cover(squares(spark, sf), RES)


@query("L5_dissolve_lines", "SELECT p, count(*) AS n_features, count(*) * 4 AS n_segments, count(*) * 3 + 1 AS n_distinct FROM sq GROUP BY 1")
def _(spark, sf):
    return P.dissolve_stats(squares(spark, sf), "p")


@query("L6_dissolve_areas", "SELECT DISTINCT p, cell FROM hexes")
def _(spark, sf):
    return P.dissolve_areas(squares(spark, sf), "p", RES)


@query("L7_tile_cover", "SELECT code, CAST(z AS INTEGER) AS z, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty FROM tiles")
def _(spark, sf):
    return P.tile_cover(squares(spark, sf), 9, 13).select("code", "z", "tx", "ty")


@query("L8_tile_layer", "SELECT 'sal' AS layer, CAST(z AS INTEGER) AS z, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, count(*) AS n_features FROM tiles GROUP BY ALL")
def _(spark, sf):
    return P.tile_counts(_tiles(spark, sf))


@query("L9_thin_vertices", """
SELECT code, pos, round(x0 + dx / 128.0::DOUBLE, 6) AS x, round(y0 + dy / 128.0::DOUBLE, 6) AS y FROM sq
CROSS JOIN (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) v(pos, dx, dy)""")
def _(spark, sf):
    rows = squares(spark, sf)
    ring = F.get(F.get("geom", 0), 0)
    # A bump far below the tolerance near the middle of the first side, and another on the third.
    bump = lambda a, b: F.struct(((a["x"] * 3 + b["x"]) / 4).alias("x"), (a["y"] + 1e-7).alias("y"))
    pts = [F.get(ring, i) for i in range(5)]
    wavy = F.array(pts[0], bump(pts[0], pts[1]), pts[1], pts[2], bump(pts[2], pts[3]), pts[3], pts[4])
    thin = P.thin_vertices(rows.select("code", F.array(F.array(wavy)).alias("geom")), 1e-4)
    out = thin.select("code", F.posexplode(F.get(F.get("geom", 0), 0)).alias("pos", "v"))
    return out.select("code", "pos", "v.x", "v.y")


@query("L10_region_names", "SELECT s_suppkey, trim(replace(s_name, '#0000', '')) AS name FROM supplier")
def _(spark, sf):
    return B.table(spark, sf, "supplier").select("s_suppkey", C.strip_qualifier("s_name", "#0000").alias("name"))


@query("L11_label_anchor", "SELECT code, x0 + 1 / 128.0::DOUBLE AS anchor_x, y0 AS anchor_y, 'T ' || CAST(s % 60 AS VARCHAR) || 'm' AS text FROM sq")
def _(spark, sf):
    text = F.format_string("T %dm", (F.col("code").cast("int") - 20000) % 60)
    return P.label_anchor(squares(spark, sf), text).select("code", "anchor_x", "anchor_y", "text")


@query("L12_ramp", f"""
SELECT code, dwelling_type, bedrooms, CAST(floor(t * 5) AS INTEGER) AS stop, round(t * 5 - floor(t * 5), 6) AS frac, round(value / hi * 5000, 6) AS elevation
FROM (SELECT *, CASE WHEN hi <= lo THEN 0.0 ELSE (value - lo) / (hi - lo) END AS t FROM
  (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM ({cube.LATEST_POLY}) WHERE data_type = 'rental' WINDOW w AS (PARTITION BY dwelling_type, bedrooms)))""")
def _(spark, sf):
    latest = cube._latest_poly(spark, sf).filter(F.col("data_type") == "rental")
    domain = aggs.value_domain(latest, ["dwelling_type", "bedrooms"])
    rows = latest.join(domain, ["dwelling_type", "bedrooms"])
    stop, frac = C.ramp_position("value", "value_min", "value_max")
    top = F.when(F.col("value_max") > 0, F.col("value_max")).otherwise(1.0)
    return rows.select("code", "dwelling_type", "bedrooms", stop.alias("stop"), r6(frac).alias("frac"), r6(F.col("value") / top * 5000).alias("elevation"))


