"""2D spatial joins and 2L: point-in-polygon, adjacency, cell and tile covers, dissolves.

Candidates come from equi-joins on grid cells. A polygon picks the grid level at which it spans at
most a few cells, so neither a tiny cell size nor one huge polygon multiplies rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermark.functions import geometry as G
from quartermark.functions.columns import col, let
from quartermark.session import cut


def reproject(df: DataFrame, source: int, target: int, geom: str = "geom") -> DataFrame:
    """L1."""
    return df.withColumn(geom, G.reproject(geom, source, target))


def centroid_area(df: DataFrame, geom: str = "geom") -> DataFrame:
    """L2. Area centroid and area in the units of the coordinates."""
    out = df.withColumn("__m", G.moments(geom))
    return out.withColumns(
        {
            "cx": F.col("__m.mx") / F.col("__m.a"),
            "cy": F.col("__m.my") / F.col("__m.a"),
            "area": F.col("__m.a"),
        }
    ).drop("__m")


def centroids_wgs84(df: DataFrame, geom: str = "geom") -> DataFrame:
    """L2. Centroid in degrees with the area in square kilometres from the projected polygon."""
    areas = df.withColumn("__p", G.moments(G.reproject(geom, 4326, 7855)))
    return centroid_area(areas, geom).withColumn("area_km2", F.col("__p.a") / 1e6).drop("__p", "area")


def interior_points(df: DataFrame, geom: str = "geom") -> DataFrame:
    """L3."""
    return df.withColumn("__p", G.interior_point(geom)).select("*", "__p.x", "__p.y").drop("__p")


def total_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    """E20."""
    boxes = df.select(G.bbox(geom).alias("b")).select("b.*")
    return boxes.agg(*[f.alias(n) for n, f in G.extent_aggs("minx", "miny", "maxx", "maxy").items()])


def with_boxes(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumn("__b", G.bbox(geom)).select("*", "__b.*").drop("__b")


# --- D8 ------------------------------------------------------------------------


def _grid(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("bigint")


#: Points that a cell of a polygon's cover should hold, and how often a cover is halved at most.
CELL_POINTS, DEEPEST = 4096, 8


def _cells(rows: DataFrame, level: str) -> DataFrame:
    span = lambda lo, hi: F.explode(F.sequence(_grid(F.col(lo), F.col(level)), _grid(F.col(hi), F.col(level))))
    return rows.withColumn("__cx", span("minx", "maxx")).withColumn("__cy", span("miny", "maxy"))


def _probes(points: DataFrame, levels: list[int]) -> DataFrame:
    """Points once per level with their cell there."""
    probe = points.withColumn("__lv", F.explode(F.array(*[F.lit(u) for u in levels])) if levels else F.lit(None).cast("int"))
    return probe.withColumn("__cx", _grid(F.col("x"), F.col("__lv"))).withColumn("__cy", _grid(F.col("y"), F.col("__lv")))


def polygon_cover(points: DataFrame, polys: DataFrame, geom: str = "geom", cell_points: int = CELL_POINTS, deepest: int = DEEPEST) -> DataFrame:
    """D8. The columns of `polys` by cell (__lv, __cx, __cy), with __edges and __all.

    A polygon's coarse level is the power of two no smaller than its longer side, so it touches at most
    2 x 2 cells there. Counts of the points in these cells tell how often its cover is halved: a
    quadtree level per factor of four above `cell_points`. A cell that no edge's box meets lies wholly
    inside (__all, no edges) or is left out; a border cell carries the edges that a ray to the right
    from within it can meet.
    """
    boxed = with_boxes(polys, geom).withColumn("__edges", G.edges(geom)).withColumn("__p", F.xxhash64(geom)).drop(geom)
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    boxed = boxed.withColumn("__top", F.ceil(F.log2(F.greatest(side, F.lit(1e-9)))).cast("int"))
    tops = [r[0] for r in boxed.select("__top").distinct().collect() if r[0] is not None]
    at = ["__lv", "__cx", "__cy"]
    counts = _probes(points.select("x", "y"), tops).groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    coarse = _cells(boxed.select("__p", "minx", "miny", "maxx", "maxy", F.col("__top").alias("__lv")).distinct(), "__lv")
    held = coarse.join(counts, at).groupBy("__p").agg(F.sum("__n").alias("__n"))
    halved = F.least(F.lit(deepest), F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / cell_points) / 2))).cast("int")
    # Polygons without a point in their coarse cells drop out here.
    sized = boxed.join(held.select("__p", halved.alias("__k")), "__p").withColumn("__lv", F.col("__top") - F.col("__k"))
    width = F.pow(F.lit(2.0), F.col("__lv"))
    x0, y0 = F.col("__cx") * width, F.col("__cy") * width
    low = lambda e, a: F.least(e[a + "1"], e[a + "2"])
    high = lambda e, a: F.greatest(e[a + "1"], e[a + "2"])
    # Bands first, each with the edges of its heights; then the cells of a band.
    span = lambda lo, hi: F.explode(F.sequence(_grid(F.col(lo), F.col("__lv")), _grid(F.col(hi), F.col("__lv"))))
    banded = sized.withColumn("__cy", span("miny", "maxy"))
    banded = banded.withColumn("__edges", F.filter("__edges", lambda e: (high(e, "y") >= y0) & (low(e, "y") <= y0 + width)))
    cells = banded.withColumn("__cx", span("minx", "maxx"))
    cells = cells.withColumn("__edges", F.filter("__edges", lambda e: high(e, "x") >= x0)).filter(F.size("__edges") > 0)
    cells = cells.withColumn("__all", ~F.exists("__edges", lambda e: low(e, "x") <= x0 + width))
    inside = ~F.col("__all") | G.contains("__edges", x0 + width / 2, y0 + width / 2)
    bare = F.when(F.col("__all"), F.slice("__edges", 1, 0)).otherwise(F.col("__edges"))
    return cells.filter(inside).withColumn("__edges", bare).drop("__p", "__top", "__k")


def within_join(points: DataFrame, polys: DataFrame, geom: str = "geom", cell_points: int = CELL_POINTS, deepest: int = DEEPEST) -> DataFrame:
    """D8. Each point (x, y) with every polygon that contains it.

    Points meet the cells of the polygons' covers, which are as fine as the points are dense: one polygon
    over all points spreads over many tasks, and points in cells wholly inside it need no edge test. The
    levels in use (at most ~70, from the exponent range) are read first; a point is then probed once per
    level.
    """
    cover = cut(polygon_cover(points, polys, geom, cell_points, deepest))
    used = [r[0] for r in cover.select("__lv").distinct().collect()]
    hits = _probes(points, used).join(cover, ["__lv", "__cx", "__cy"])
    near = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    inside = hits.filter(F.col("__all") | (near & G.contains("__edges", F.col("x"), F.col("y"))))
    return inside.drop("__lv", "__cx", "__cy", "__edges", "__all", "minx", "miny", "maxx", "maxy")


def crosswalk(regions: DataFrame, parents: DataFrame) -> DataFrame:
    """D8. Region to parent by the region's interior point."""
    pts = interior_points(regions.select(F.col("code").alias("sal_code"), "geom")).drop("geom")
    shapes = parents.select(F.col("code").alias("lga_code"), F.col("name").alias("lga_name"), "geom")
    return within_join(pts, shapes).groupBy("sal_code").agg(F.min(F.struct("lga_code", "lga_name")).alias("p")).select(
        "sal_code", "p.*"
    )


# --- D9 ------------------------------------------------------------------------


def touching_pairs(polys: DataFrame, key: str = "code", geom: str = "geom", dp: int = 9) -> DataFrame:
    """D9. Pairs of polygons whose boundaries meet, least key first: a shared vertex, or a vertex of
    one on an edge of the other.

    Boundaries of a coverage meet in no other way. Shared vertices meet by equality. For the rest an
    edge covers at most 2 x 2 cells of a grid as coarse as itself, and a vertex is looked up once per
    grid size in use; every hit that passes the distance test is a touching pair.
    """
    grid = lambda v: F.round(v * 10**dp).cast("bigint")
    v = polys.select(key, F.explode(F.array_distinct(F.transform(G.vertices(geom), lambda p: F.struct(grid(p["x"]).alias("x"), grid(p["y"]).alias("y"))))).alias("v"))
    flat = v.select(key, "v.x", "v.y")
    other = flat.select(F.col(key).alias("dst"), "x", "y")
    pairs = flat.withColumnRenamed(key, "src").join(other, ["x", "y"]).filter(F.col("src") < F.col("dst")).select("src", "dst")
    e = polys.select(F.col(key).alias("dst"), F.explode(G.edges(geom)).alias("e")).select("dst", "e.*")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    e = e.withColumn("__lv", F.ceil(F.log2(F.greatest(F.abs(dx), F.abs(dy), F.lit(10.0**-dp)))).cast("int"))
    used = [r[0] for r in e.select("__lv").distinct().collect()]
    span = lambda a, b: F.explode(F.sequence(_grid(F.least(a, b), F.col("__lv")), _grid(F.greatest(a, b), F.col("__lv"))))
    cover = e.withColumn("__cx", span("x1", "x2")).withColumn("__cy", span("y1", "y2"))
    points = polys.select(F.col(key).alias("src"), F.explode(F.array_distinct(G.vertices(geom))).alias("p")).select("src", "p.x", "p.y")
    probe = points.withColumn("__lv", F.explode(F.array(*[F.lit(u) for u in used])) if used else F.lit(None).cast("int"))
    probe = probe.withColumn("__cx", _grid(F.col("x"), F.col("__lv"))).withColumn("__cy", _grid(F.col("y"), F.col("__lv")))
    off = F.abs(dx * (F.col("y") - F.col("y1")) - dy * (F.col("x") - F.col("x1"))) <= 10.0**-dp * F.hypot(dx, dy)
    between = F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    inside = probe.join(cover, ["__lv", "__cx", "__cy"]).filter((F.col("src") != F.col("dst")) & between & off)
    return pairs.unionByName(inside.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).distinct()


# --- L4, L6 ----------------------------------------------------------------------


def hex_size(resolution: int) -> float:
    """Edge length in metres."""
    return 1_000_000.0 / 2**resolution


def covered_cells(polys: DataFrame, resolution: int, key: str, geom: str = "geom") -> DataFrame:
    """(key, cell) for every hexagonal cell whose centre lies in a polygon given in degrees.

    Cells are axial (q, r) on Web Mercator. Each edge meets the rows of cells it crosses; a row's
    crossings in order pair up to spans, and a span gives its run of cells. So no row carries the
    polygon: what is shuffled is one crossing per edge and row, and cells are made after that, spread
    by row.
    """
    s = hex_size(resolution)
    dx, dy = s * math.sqrt(3), s * 1.5
    flat = polys.select(key, G.reproject(geom, 4326, 3857).alias("__g")).withColumn("__f", F.xxhash64("__g")).dropDuplicates([key, "__f"])
    e = flat.select(key, "__f", F.explode(G.edges("__g")).alias("e")).select(key, "__f", "e.*")
    lo, hi = F.floor(F.least("y1", "y2") / dy), F.ceil(F.greatest("y1", "y2") / dy)
    y = F.col("r") * dy
    crossed = e.withColumn("r", F.explode(F.sequence(lo, hi))).filter((F.col("y1") > y) != (F.col("y2") > y))
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    lines = crossed.select(key, "__f", "r", at.alias("at")).groupBy(key, "__f", "r").agg(F.sort_array(F.collect_list("at")).alias("xs"))
    pair = F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1))
    runs = lines.filter(F.size("xs") > 1).withColumn("i", pair).select(key, "r", F.get("xs", F.col("i") * 2).alias("a"), F.get("xs", F.col("i") * 2 + 1).alias("b"))
    place = lambda x: F.ceil(F.col(x) / dx - F.col("r") / 2)
    cells = runs.withColumn("q", F.explode(F.sequence(place("a") - 1, place("b") + 1)))
    x = (F.col("q") + F.col("r") / 2) * dx
    cell = F.concat_ws(":", F.lit(f"h{resolution}"), F.col("q").cast("string"), F.col("r").cast("string"))
    return cells.filter((x >= F.col("a")) & (x < F.col("b"))).select(key, cell.alias("cell"))


def cell_cover(polys: DataFrame, resolution: int, key: str = "code", geom: str = "geom") -> DataFrame:
    """L4. Cell to region; a centre claimed twice goes to the least key."""
    return covered_cells(polys, resolution, key, geom).groupBy("cell").agg(F.min(key).alias(key))


def dissolve_areas(df: DataFrame, key: str, resolution: int, geom: str = "geom") -> DataFrame:
    """L6. Union of the areas of each key, as the distinct cells they cover."""
    return covered_cells(df, resolution, key, geom).distinct()


# --- L5, L9 ----------------------------------------------------------------------


def line_segments(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """Segments with their ends in a fixed order, so overlaps drawn both ways are equal."""
    e = df.select(key, F.explode(G.edges(geom)).alias("e"))
    a, b = F.struct(F.col("e.x1").alias("x"), F.col("e.y1").alias("y")), F.struct(F.col("e.x2").alias("x"), F.col("e.y2").alias("y"))
    return e.select(key, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def dissolve_lines(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """L5. Distinct segments of each key."""
    return line_segments(df, key, geom).distinct()


def dissolve_stats(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """L5. Features and segments before and after the dissolve."""
    before = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_features"), F.sum(F.size(G.edges(geom))).alias("n_segments")
    )
    after = dissolve_lines(df, key, geom).groupBy(key).agg(F.count(F.lit(1)).alias("n_distinct"))
    return before.join(after, key, "left").fillna(0, ["n_distinct"])


def thin_vertices(polys: DataFrame, tolerance: float, dp: int = 6, key: str = "code", geom: str = "geom") -> DataFrame:
    """L9. Drop ring vertices closer than `tolerance` to the line through their neighbours.

    Vertices on more than one polygon stay, so shared borders stay aligned; so do ring ends.
    """
    # Each vertex takes its two neighbours along before the ring is exploded, so rows stay small.
    beside = lambda ring: F.transform(
        ring, lambda p, i: F.struct(F.get(ring, i - 1).alias("prev"), p.alias("p"), F.get(ring, i + 1).alias("next"))
    )
    v = polys.select(key, F.posexplode(geom).alias("part", "rings")).select(
        key, "part", F.posexplode("rings").alias("ring", "pts")
    ).select(key, "part", "ring", F.posexplode(beside(F.col("pts"))).alias("pos", "v")).select(key, "part", "ring", "pos", "v.*")
    dx, dy = F.col("next.x") - F.col("prev.x"), F.col("next.y") - F.col("prev.y")
    length = F.sqrt(dx * dx + dy * dy)
    off = F.abs(dx * (F.col("p.y") - F.col("prev.y")) - dy * (F.col("p.x") - F.col("prev.x"))) / F.nullif(length, F.lit(0.0))
    end = F.col("prev").isNull() | F.col("next").isNull()
    v = v.select(key, "part", "ring", "pos", "p", end.alias("end"), off.alias("off"), F.round("p.x", 9).alias("vx"), F.round("p.y", 9).alias("vy"))
    owners = v.groupBy("vx", "vy").agg((F.min(key) != F.max(key)).alias("shared"))
    kept = v.join(owners, ["vx", "vy"]).filter(F.col("end") | F.col("shared") | F.col("off").isNull() | (F.col("off") >= tolerance))
    pt = F.struct(F.round("p.x", dp).alias("x"), F.round("p.y", dp).alias("y"))
    order = lambda c, *k: F.transform(F.array_sort(F.collect_list(F.struct(*k, c.alias("c")))), lambda s: s["c"])
    rings = kept.groupBy(key, "part", "ring").agg(order(pt, "pos").alias("pts"))
    parts = rings.groupBy(key, "part").agg(order(F.col("pts"), "ring").alias("rings"))
    return parts.groupBy(key).agg(order(F.col("rings"), "part").alias(geom))


def label_anchor(df: DataFrame, text: Column, geom: str = "geom") -> DataFrame:
    """L11. Easternmost vertex of the exterior ring, the first one on ties, and the label."""
    ring = F.get(F.get(col(geom), 0), 0)
    at = F.array_max(F.transform(ring, lambda v, i: F.struct(v["x"].alias("x"), (-i).alias("first"), v["y"].alias("y"))))
    return df.withColumn("__a", at).withColumn("text", text).select(
        "*", F.col("__a.x").alias("anchor_x"), F.col("__a.y").alias("anchor_y")
    ).drop("__a").filter(F.col("anchor_x").isNotNull())


# --- D10, L7, L8 -------------------------------------------------------------------

EPS = 1e-11


def tile_x(lon: Column, n: Column) -> Column:
    return F.least(n - 1, F.greatest(F.lit(0.0), F.floor((lon + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat: Column, n: Column) -> Column:
    s = F.sin(F.radians(lat))
    frac = F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)
    return F.least(n - 1, F.greatest(F.lit(0.0), F.floor(frac * n))).cast("int")


def tile_west(tx: Column, n: Column) -> Column:
    return tx / n * 360.0 - 180.0


def tile_north(ty: Column, n: Column) -> Column:
    return F.degrees(F.atan(F.sinh((F.lit(1.0) - ty * 2.0 / n) * math.pi)))


def tile_candidates(features: DataFrame, min_zoom: int, max_zoom: int, geom: str = "geom") -> DataFrame:
    """D10. Tiles whose box meets a feature's box, one row per (feature, tile)."""
    if min_zoom > max_zoom:
        raise ValueError(f"min_zoom {min_zoom} is above max_zoom {max_zoom}")
    z = F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom)))
    n = F.pow(F.lit(2.0), F.col("z"))
    rows = with_boxes(features, geom).withColumn("z", z).withColumn("__n", n)
    y0, y1 = tile_y(F.col("maxy"), F.col("__n")), tile_y(F.col("miny") + EPS, F.col("__n"))
    rows = rows.withColumn("ty", F.explode(F.sequence(y0, F.greatest(y0, y1))))
    x0, x1 = tile_x(F.col("minx"), F.col("__n")), tile_x(F.col("maxx") - EPS, F.col("__n"))
    return rows.withColumn("tx", F.explode(F.sequence(x0, F.greatest(x0, x1))))


#: Zooms that are gone down between two writes.
STRIDE = 3


def tile_cover(features: DataFrame, min_zoom: int, max_zoom: int, geom: str = "geom", closed: bool = True) -> DataFrame:
    """L7. Tiles that a feature really meets: an edge in the tile, or the tile inside the polygon.

    Zooms are gone down one by one: only tiles hit at a zoom are split at the next, each with the edges
    that can still matter below it; every STRIDE zooms they are written and spread. A tile without edges inside the polygon carries
    none from there on. So a feature as large as the world is spread after the first zooms, and the work
    follows the tiles that are hit.
    """
    shaped = features.withColumn("__e", G.edges(geom)).withColumn("__v", F.when(F.size("__e") == 0, G.vertices(geom)))
    rest = [c for c in features.columns if c != geom]
    rows = tile_candidates(shaped, min_zoom, min_zoom, geom).drop(geom).withColumn("__whole", F.lit(False))
    found = []
    for z in range(min_zoom, max_zoom + 1):
        n = F.lit(float(2**z))
        w, e = tile_west(F.col("tx"), n), tile_west(F.col("tx") + 1, n)
        north, south = tile_north(F.col("ty"), n), tile_north(F.col("ty") + 1, n)
        at = lambda s, end, of: of(s[f"{end}1"], s[f"{end}2"])
        boxed = rows.withColumn("__b", F.struct(w.alias("w"), south.alias("s"), e.alias("e"), north.alias("n")))
        # Edges that meet the tile, or that a ray to the right from within it can meet.
        b = F.col("__b")
        within = lambda s: (at(s, "y", F.greatest) >= b["s"]) & (at(s, "y", F.least) <= b["n"]) & (at(s, "x", F.greatest) >= b["w"])  # noqa: B023, E731
        near = boxed.withColumn("__e", F.filter("__e", within))
        near = near.withColumn("__near", F.exists("__e", lambda s: at(s, "x", F.least) <= b["e"]))  # noqa: B023
        edge = F.exists("__e", lambda s: G.edge_meets_box(s, b["w"], b["s"], b["e"], b["n"]))  # noqa: B023
        middle = G.contains("__e", (b["w"] + b["e"]) / 2, (b["s"] + b["n"]) / 2) if closed else F.lit(False)
        point = F.coalesce(F.exists("__v", lambda v: v["x"].between(b["w"], b["e"]) & v["y"].between(b["s"], b["n"])), F.lit(False))  # noqa: B023
        hit = near.filter(F.col("__whole") | edge | middle | point)
        hit = hit.withColumn("__whole", F.col("__whole") | (~F.col("__near") & F.col("__v").isNull()))
        hit = hit.withColumn("__e", F.when(F.col("__whole"), F.slice("__e", 1, 0)).otherwise(F.col("__e")))
        hit = hit.drop("__b", "__near", "__n")
        if (z - min_zoom) % STRIDE == STRIDE - 1 and z < max_zoom:
            hit = cut(hit)
        found.append(hit.select(*rest, "minx", "miny", "maxx", "maxy", F.lit(z).alias("z"), "ty", "tx"))
        below = F.lit(float(2 ** (z + 1)))
        y0, y1 = tile_y(F.col("maxy"), below), tile_y(F.col("miny") + EPS, below)
        x0, x1 = tile_x(F.col("minx"), below), tile_x(F.col("maxx") - EPS, below)
        half = F.explode(F.array(F.lit(0), F.lit(1)))
        rows = hit.withColumn("__i", half).withColumn("ty", F.col("ty") * 2 + F.col("__i")).filter(F.col("ty").between(y0, F.greatest(y0, y1)))
        rows = rows.withColumn("__i", half).withColumn("tx", F.col("tx") * 2 + F.col("__i")).filter(F.col("tx").between(x0, F.greatest(x0, x1))).drop("__i")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# Zoom ranges and kept properties per layer.
LAYERS = {
    "sal": (6, 13, ["code", "name"]),
    "lga": (5, 12, ["code", "name"]),
    "school_zones": (7, 11, ["code", "name"]),
    "isochrone": (7, 13, ["code", "name"]),
    "ptv_lines": (7, 13, ["code", "name"]),
}
# Fixed value: the layers of lines.
LINES = ("ptv_lines",)


def tile_layer(
    features: DataFrame, layer: str, min_zoom: int, max_zoom: int, keep: list[str], geom: str = "geom", closed: bool = True
) -> DataFrame:
    """L8. (layer, z, tx, ty, properties, box) rows; write them partitioned by (layer, z)."""
    missing = [c for c in keep if c not in features.columns]
    if missing:
        raise ValueError(f"missing properties {missing}")
    cover = tile_cover(features.select(*keep, geom), min_zoom, max_zoom, geom, closed)
    return cover.select(F.lit(layer).alias("layer"), "z", "tx", "ty", *keep, "minx", "miny", "maxx", "maxy")


def write_tile_layers(layers: dict[str, DataFrame], path: str, geom: str = "geom") -> None:
    """L8. Features of each preset layer as tiles below `path`, partitioned by (layer, z).

    Zoom ranges and properties come from LAYERS; line layers have no inside. Writing a layer again
    replaces its own partitions and leaves the others.
    """
    unknown = sorted(set(layers) - set(LAYERS))
    if unknown:
        raise ValueError(f"unknown layers {unknown}")
    for layer, features in layers.items():
        low, high, keep = LAYERS[layer]
        tiles = tile_layer(features, layer, low, high, keep, geom, closed=layer not in LINES)
        tiles.repartition("layer", "z", "tx", "ty").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "z").parquet(path)


def tile_counts(tiles: DataFrame) -> DataFrame:
    """L8. Features per non-empty tile."""
    return tiles.groupBy("layer", "z", "tx", "ty").agg(F.count(F.lit(1)).alias("n_features"))

