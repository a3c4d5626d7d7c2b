import json

import pytest
from helpers import square
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.functions import geometry as G
from quartermark.plans import spatial as P
from quartermark.sources import readers, sinks
from quartermark.sources.readers import POLYGON

SHAPE = f"code string, name string, geom {POLYGON}"


def grid(spark, n, step=1.0, x=0.0, y=0.0):
    return spark.createDataFrame([(str(20001 + i), "r", square(x + (i % n) * step, y + (i // n) * step, step, step)) for i in range(n * n)], SHAPE)


def test_centroids_of_squares(spark):
    seeds = [(144.0, -37.8), (144.5, -37.7), (145.0, -37.6)]
    df = spark.createDataFrame([(str(i), "r", square(x - 0.005, y - 0.005, 0.01, 0.01)) for i, (x, y) in enumerate(seeds)], SHAPE)
    got = sorted((r.code, r.cx, r.cy) for r in P.centroids_wgs84(df).collect())
    assert [g[1:] for g in got] == [pytest.approx(s, abs=1e-6) for s in seeds]


def test_holes_and_parts_count(spark):
    outer, hole = square(0.0, 0.0, 4.0, 4.0)[0][0], square(1.0, 1.0, 2.0, 2.0)[0][0][::-1]
    geom = [[outer, hole], square(10.0, 0.0)[0]]
    df = spark.createDataFrame([("a", "a", geom)], SHAPE)
    r = P.centroid_area(df).first()
    assert r.area == pytest.approx(13) and r.cx == pytest.approx((12 * 2 + 10.5) / 13)
    inside = lambda x, y: df.select(G.contains(G.edges("geom"), F.lit(x), F.lit(y))).first()[0]
    assert [inside(0.5, 2.0), inside(2.0, 2.0), inside(10.5, 0.5), inside(7.0, 0.5)] == [True, False, True, False]
    p = P.interior_points(df).first()
    assert inside(p.x, p.y)


def test_interior_point_of_parts_with_a_gap_at_half_height(spark):
    df = spark.createDataFrame([("a", "a", [square(0.0, 0.0)[0], square(0.0, 9.0)[0]])], SHAPE)
    p = P.interior_points(df).first()
    assert df.select(G.contains(G.edges("geom"), F.lit(p.x), F.lit(p.y))).first()[0]


def test_mga_projection_known_mark(spark):
    # Published coordinates of the Flinders Peak survey mark, zone 55.
    lon, lat = 144 + 25 / 60 + 29.52440 / 3600, -(37 + 57 / 60 + 3.72030 / 3600)
    v = spark.range(1).select(G.to_mga(F.struct(F.lit(lon).alias("x"), F.lit(lat).alias("y"))).alias("v")).first().v
    assert (v.x, v.y) == (pytest.approx(273741.297, abs=0.002), pytest.approx(5796489.777, abs=0.002))


def test_mercator_round_trip(spark):
    v = spark.range(1).select(G.from_mercator(G.to_mercator(F.struct(F.lit(144.9).alias("x"), F.lit(-37.8).alias("y")))).alias("v")).first().v
    assert (v.x, v.y) == (pytest.approx(144.9), pytest.approx(-37.8))


def test_touching_pairs_of_a_grid(spark):
    assert P.touching_pairs(grid(spark, 5)).count() == 2 * 5 * 4 + 2 * 16


def test_within_join_mixed_sizes(spark):
    polys = spark.createDataFrame([("big", "b", square(0.0, 0.0, 1000.0, 1000.0)), ("tiny", "t", square(3.0, 3.0, 0.01, 0.01))], SHAPE)
    pts = spark.createDataFrame([(1, 3.005, 3.005), (2, 999.0, 1.0), (3, -1.0, 5.0)], "id int, x double, y double")
    got = sorted((r.id, r.code) for r in P.within_join(pts, polys).collect())
    assert got == [(1, "big"), (1, "tiny"), (2, "big")]


def test_tile_cover_of_a_triangle_skips_empty_corners(spark):
    tri = [[[(144.0, -38.0), (145.0, -38.0), (144.0, -37.0), (144.0, -38.0)]]]
    df = spark.createDataFrame([("a", "a", tri)], SHAPE)
    box, cover = P.tile_candidates(df, 11, 11).count(), P.tile_cover(df, 11, 11).count()
    assert 0.4 * box < cover < 0.7 * box


def test_thinning_keeps_shared_vertices(spark):
    a = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (1.0, 1.0), (0.0, 1.0), (0.0, 0.5), (0.0, 0.0)]]]
    b = [[[(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 0.5), (1.0, 0.0)]]]
    out = {r.code: r.geom[0][0] for r in P.thin_vertices(spark.createDataFrame([("a", "a", a), ("b", "b", b)], SHAPE), 1e-3).collect()}
    xy = lambda k: [(v.x, v.y) for v in out[k]]
    assert (1.0, 0.5) in xy("a") and (1.0, 0.5) in xy("b") and (0.0, 0.5) not in xy("a")


def test_overlapping_lines_dissolve(spark):
    line = lambda pts: [[pts]]
    df = spark.createDataFrame([("r1", "a", line([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])), ("r1", "b", line([(2.0, 0.0), (1.0, 0.0)]))], SHAPE)
    assert [tuple(r) for r in P.dissolve_stats(df, "code").collect()] == [("r1", 2, 3, 2)]


def test_feature_documents_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"code": "1", "name": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0.1234567, 0], [1, 0], [1, 1], [0.1234567, 0]]]}},
        {"type": "Feature", "properties": {"code": "2", "name": "y"}, "geometry": None},
    ]}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(doc, indent=1))
    props = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType())])
    rows = readers.scan_features(spark, str(path), props, layout="document")
    got = {r.code: r.geom for r in rows.collect()}
    assert got["2"] is None and len(got["1"][0][0]) == 4
    text = json.loads(sinks.to_features(rows.filter("code = '1'"), ["code"]).first()[0])
    assert text["geometry"]["coordinates"][0][0][0] == [0.123457, 0.0]
    with pytest.raises(ValueError):
        sinks.to_features(rows, ["absent"])


def test_conform_refuses_null(spark):
    want = T.StructType([T.StructField("a", T.IntegerType(), False)])
    ok = spark.createDataFrame([("1",)], "a string")
    assert sinks.conform(ok, want).first().a == 1
    with pytest.raises(Exception, match="NULL in a"):
        sinks.conform(spark.createDataFrame([(None,)], "a string"), want).collect()


def test_contact_inside_an_edge(spark):
    rows = [("big", square(0.0, 0.0, 2.0, 2.0)), ("side", square(2.0, 0.5)), ("corner", square(3.0, 1.5)), ("far", square(5.0, 5.0)), ("near", square(2.001, 3.0))]
    polys = spark.createDataFrame(rows, "code string, geom array<array<array<struct<x:double,y:double>>>>")
    got = {(r.src, r.dst) for r in P.touching_pairs(polys).collect()}
    assert got == {("big", "side"), ("corner", "side")}


def ring(rng, cx, cy, n, low, high):
    """A star-shaped ring, concave where radii vary."""
    import math

    radii = [rng.uniform(low, high) for _ in range(n)]
    pts = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(radii)]
    return [*pts, pts[0]]


def odd_polygons(spark):
    import random

    rng = random.Random(11)
    shapes = [("world", "w", [[ring(rng, 0.0, 0.0, 40, 50.0, 80.0), ring(rng, 3.0, 2.0, 12, 5.0, 20.0)]])]
    shapes += [(f"s{i}", "s", [[ring(rng, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.randrange(3, 30), 0.05, rng.choice([0.5, 5.0, 30.0]))]]) for i in range(25)]
    shapes.append(("two", "t", [[ring(rng, -20.0, 10.0, 9, 1.0, 6.0)], [ring(rng, 20.0, 10.0, 9, 1.0, 6.0)]]))
    shapes += [("twin", "t", [square(1.0, 1.0, 8.0, 8.0)[0]])] * 2 + [("far", "f", [square(500.0, 500.0)[0]])]
    return shapes, spark.createDataFrame(shapes, SHAPE)


def odd_even(geom, x, y):
    n = 0
    for part in geom:
        for r in part:
            for a, b in zip(r, r[1:]):
                if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
                    n += 1
    return n % 2 == 1


def test_points_in_unequal_polygons_with_holes(spark):
    import random

    rng = random.Random(12)
    shapes, polys = odd_polygons(spark)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(600)] + [(600 + i, rng.gauss(5, 0.5), rng.gauss(5, 0.5)) for i in range(600)]
    spots += [(1200, 1.0, 1.0), (1201, 9.0, 9.0), (1202, 4.0, 8.0), (1203, 0.0, 0.0)]
    points = spark.createDataFrame(spots, "id int, x double, y double")
    want = sorted((i, code) for i, x, y in spots for code, _, g in shapes if odd_even(g, x, y))
    for cell_points, deepest in ((4096, 8), (20, 8), (1, 3)):
        got = P.within_join(points, polys, cell_points=cell_points, deepest=deepest)
        assert got.columns == ["id", "x", "y", "code", "name"]
        assert sorted((r.id, r.code) for r in got.collect()) == want
    cover = P.polygon_cover(points, polys, cell_points=1).filter("code = 'world'")
    most, cells, whole = cover.agg(F.max(F.size("__edges")), F.count("__lv"), F.count_if("__all")).first()
    assert cells > 300 and whole > 100 and most < 42


def test_cells_of_concave_shapes_and_holes(spark):
    shapes, polys = odd_polygons(spark)
    small = [s for s in shapes if s[0] not in ("far",)]
    df = polys.filter("code <> 'far'")
    flat = {i: r.g for i, r in enumerate(df.select(G.reproject("geom", 4326, 3857).alias("g")).collect())}
    resolution = 2
    size = P.hex_size(resolution)
    dx, dy = size * 3**0.5, size * 1.5
    want = set()
    for i, (code, *_) in enumerate(small):
        xs, ys = zip(*((p.x, p.y) for part in flat[i] for r in part for p in r))
        for r in range(int(min(ys) / dy) - 2, int(max(ys) / dy) + 3):
            for q in range(int(min(xs) / dx - r / 2) - 2, int(max(xs) / dx - r / 2) + 3):
                if odd_even(flat[i], (q + r / 2) * dx, r * dy):
                    want.add((code, f"h{resolution}:{q}:{r}"))
    got = P.dissolve_areas(df, "code", resolution)
    assert len(want) > 100 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def plain_cover(features, low, high, closed=True):
    """Every tile of the box of every feature, tested with all its edges."""
    rows = P.tile_candidates(features, low, high).withColumn("__e", G.edges("geom"))
    n = F.col("__n")
    w, e, north, south = P.tile_west(F.col("tx"), n), P.tile_west(F.col("tx") + 1, n), P.tile_north(F.col("ty"), n), P.tile_north(F.col("ty") + 1, n)
    hit = F.exists("__e", lambda s: G.edge_meets_box(s, w, south, e, north))
    if closed:
        hit = hit | G.contains("__e", (w + e) / 2, (south + north) / 2)
    return rows.filter(hit)


@pytest.mark.parametrize("closed", [True, False])
def test_descending_zooms_finds_the_tiles_of_every_box(spark, closed):
    _, polys = odd_polygons(spark)
    df = polys.filter("code <> 'far'")
    key = ["code", "z", "ty", "tx"]
    got, want = (sorted(map(tuple, x.select(*key).collect())) for x in (P.tile_cover(df, 0, 5, closed=closed), plain_cover(df, 0, 5, closed)))
    assert got == want and len(got) > 500


def test_layers_are_written_by_preset(spark, tmp_path):
    path = str(tmp_path / "tiles")
    P.write_tile_layers({"sal": grid(spark, 2, 0.01, 144.0, -37.0), "school_zones": grid(spark, 1, 0.01, 144.0, -37.0)}, path)
    read = lambda: {(r.layer, r.z): r.n for r in spark.read.parquet(path).groupBy("layer", "z").agg(F.countDistinct("code").alias("n")).collect()}
    assert read() == {("sal", z): 4 for z in range(6, 14)} | {("school_zones", z): 1 for z in range(7, 12)}
    P.write_tile_layers({"sal": grid(spark, 3, 0.01, 144.0, -37.0)}, path)
    assert read()["sal", 9] == 9 and read()["school_zones", 9] == 1
    with pytest.raises(ValueError):
        P.write_tile_layers({"roads": grid(spark, 1)}, path)
