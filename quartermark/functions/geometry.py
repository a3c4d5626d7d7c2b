"""Geometry as Column expressions over coordinate arrays: polygon -> ring -> vertex(x, y).

A line is a polygon value with one open ring, a point one with a single vertex.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartermark.functions.columns import col, let

EARTH = 6378137.0


def vertices(geom: Column | str) -> Column:
    return F.flatten(F.flatten(col(geom)))


def ring_edges(ring: Column) -> Column:
    n = F.size(ring)
    join = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    pairs = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), join)
    return F.when(n > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def edges(geom: Column | str) -> Column:
    """Every segment of every ring as struct(x1, y1, x2, y2)."""
    return F.flatten(F.transform(F.flatten(col(geom)), ring_edges))


def map_vertices(geom: Column | str, fn) -> Column:
    return F.transform(col(geom), lambda part: F.transform(part, lambda ring: F.transform(ring, fn)))


def bbox(geom: Column | str) -> Column:
    """struct(minx, miny, maxx, maxy)."""
    xs = F.transform(vertices(geom), lambda v: v["x"])
    ys = F.transform(vertices(geom), lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")
    )


def extent_aggs(minx: str, miny: str, maxx: str, maxy: str) -> dict[str, Column]:
    return {"west": F.min(minx), "south": F.min(miny), "east": F.max(maxx), "north": F.max(maxy)}


def _ring_moments(ring: Column) -> Column:
    """Shoelace sums about the ring's first vertex: signed double area and first moments."""
    ox, oy = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, e):
        x1, y1, x2, y2 = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        cross = x1 * y2 - x2 * y1
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (x1 + x2) * cross).alias("mx"),
            (acc["my"] + (y1 + y2) * cross).alias("my"),
        )

    def finish(acc):
        # mx / 6 + area * origin, turned so that the ring counts positive.
        sign = F.signum(acc["a"])
        area = acc["a"] / 2 * sign
        return F.struct(
            area.alias("a"),
            (acc["mx"] / 6 * sign + area * ox).alias("mx"),
            (acc["my"] / 6 * sign + area * oy).alias("my"),
        )

    return F.aggregate(ring_edges(ring), zero, step, finish)


def moments(geom: Column | str) -> Column:
    """struct(a, mx, my) of a multi-part polygon; rings after the first of a part are holes."""

    def signed(part):
        return F.transform(part, lambda ring, i: F.struct(_ring_moments(ring).alias("m"), F.when(i == 0, 1.0).otherwise(-1.0).alias("s")))

    total = F.flatten(F.transform(col(geom), signed))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        total,
        zero,
        lambda acc, r: F.struct(
            *[(acc[k] + r["m"][k] * r["s"]).alias(k) for k in ("a", "mx", "my")]
        ),
    )


def contains(edge_list: Column | str, x: Column, y: Column) -> Column:
    """Ray crossing: the point is inside when a ray to the right meets an odd number of edges."""

    def crossing(acc, e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return acc + F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(col(edge_list), F.lit(0), crossing) % 2 == 1


def interior_point(geom: Column | str) -> Column:
    """L3. Middle of the widest inside span of the scanline at half height of the tallest part."""

    def widest(xs: Column) -> Column:
        start = F.struct(
            F.lit(-1).alias("n"), F.lit(0.0).alias("prev"), F.lit(-1.0).alias("w"), F.lit(None).cast("double").alias("x")
        )

        def step(acc, x):
            # Crossings pair up in order: every second one closes an inside span.
            closes = (acc["n"] % 2 == 0) & (x - acc["prev"] > acc["w"])
            return F.struct(
                (acc["n"] + 1).alias("n"),
                x.alias("prev"),
                F.when(closes, x - acc["prev"]).otherwise(acc["w"]).alias("w"),
                F.when(closes, (x + acc["prev"]) / 2).otherwise(acc["x"]).alias("x"),
            )

        return F.aggregate(xs, start, step, lambda acc: acc["x"])

    def at(y: Column) -> Column:
        hit = F.filter(edges(geom), lambda e: (e["y1"] > y) != (e["y2"] > y))
        xs = F.array_sort(F.transform(hit, lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
        return F.struct(F.coalesce(widest(xs), F.get(vertices(geom), 0)["x"]).alias("x"), y.alias("y"))

    def height(ys: Column) -> Column:
        return F.struct((F.array_max(ys) - F.array_min(ys)).alias("h"), ((F.array_max(ys) + F.array_min(ys)) / 2).alias("mid"))

    parts = F.transform(col(geom), lambda part: let(F.transform(F.flatten(part), lambda v: v["y"]), height))
    return let(F.array_max(parts)["mid"], at)


def edge_meets_box(e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Segment and closed box share a point: boxes overlap and the corners straddle the line."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    side = lambda x, y: dx * (y - e["y1"]) - dy * (x - e["x1"])
    corners = [side(minx, miny), side(minx, maxy), side(maxx, miny), side(maxx, maxy)]
    overlap = (
        (F.least(e["x1"], e["x2"]) <= maxx)
        & (F.greatest(e["x1"], e["x2"]) >= minx)
        & (F.least(e["y1"], e["y2"]) <= maxy)
        & (F.greatest(e["y1"], e["y2"]) >= miny)
    )
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


# --- projections (L1) --------------------------------------------------------


def to_mercator(v: Column) -> Column:
    """EPSG:4326 to EPSG:3857."""
    return F.struct(
        (F.radians(v["x"]) * EARTH).alias("x"),
        (F.log(F.tan(F.radians(v["y"]) / 2 + math.pi / 4)) * EARTH).alias("y"),
    )


def from_mercator(v: Column) -> Column:
    """EPSG:3857 to EPSG:4326."""
    return F.struct(
        F.degrees(v["x"] / EARTH).alias("x"),
        F.degrees(F.atan(F.exp(v["y"] / EARTH)) * 2 - math.pi / 2).alias("y"),
    )


def _kruger() -> tuple[float, float, list[float]]:
    """GRS80 constants of the Krueger series to fourth order in the third flattening."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    radius = EARTH / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return e, radius, alpha


def to_mga(v: Column, zone: int = 55) -> Column:
    """Longitude and latitude to metres of a Map Grid of Australia zone (transverse Mercator)."""
    e, radius, alpha = _kruger()
    k0, east0, north0 = 0.9996, 500000.0, 10000000.0

    def base(a):
        return F.struct(
            F.atan2(a["t"], F.cos(a["lam"])).alias("xi"),
            F.atanh(F.sin(a["lam"]) / F.sqrt(a["t"] * a["t"] + 1)).alias("eta"),
        )

    def series(p):
        xi, eta = p["xi"], p["eta"]
        for j, a in enumerate(alpha, 1):
            xi = xi + F.sin(p["xi"] * (2 * j)) * F.cosh(p["eta"] * (2 * j)) * a
            eta = eta + F.cos(p["xi"] * (2 * j)) * F.sinh(p["eta"] * (2 * j)) * a
        return F.struct((eta * (k0 * radius) + east0).alias("x"), (xi * (k0 * radius) + north0).alias("y"))

    start = let(
        F.struct((F.radians(v["x"] - (zone * 6 - 183))).alias("lam"), F.sin(F.radians(v["y"])).alias("s")),
        lambda a: F.struct(F.sinh(F.atanh(a["s"]) - F.atanh(a["s"] * e) * e).alias("t"), a["lam"].alias("lam")),
    )
    return let(let(start, base), series)


PROJECTIONS = {(4326, 3857): to_mercator, (3857, 4326): from_mercator, (4326, 7855): to_mga}


def reproject(geom: Column | str, source: int, target: int) -> Column:
    if source == target:
        return col(geom)
    fn = PROJECTIONS.get((source, target))
    if fn is None:
        raise ValueError(f"no projection from {source} to {target}")
    return map_vertices(geom, fn)
