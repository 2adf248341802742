"""Geometry as columns: points are doubles, lines arrays of (lat, lon), polygons arrays of rings; all built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_A_DEGREE = 111.32
POINT = "struct<lat:double,lon:double>"
LINE = f"array<{POINT}>"
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def gauss_decay(distance: Column, scale: Column | float, offset: float = 0.0, decay: float = 0.5, missing: float = 1.0) -> Column:
    """1 up to offset, decay at offset + scale; missing where there is no distance."""
    beyond = F.greatest(distance - offset, F.lit(0.0))
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.coalesce(F.exp(F.pow(beyond / scale, 2) * math.log(decay)), F.lit(missing))


def distance_confidence(metres: Column) -> Column:
    """How sure a reverse match is by its distance."""
    #: Upper bounds in metres and confidences.
    steps = [(1, 1.0), (10, 0.9), (50, 0.8), (200, 0.7), (500, 0.6), (1000, 0.5), (5000, 0.4), (10000, 0.2)]
    out = F.when(metres <= steps[0][0], steps[0][1])
    for bound, value in steps[1:]:
        out = out.when(metres <= bound, value)
    return out.otherwise(0.1)


def geohash(lat: Column, lon: Column, precision: int = 4) -> Column:
    """Geohash: bits of longitude and latitude in turns, five to a character."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2

    def part(x: Column, low: float, span: float, n: int) -> Column:
        return F.least(F.greatest(F.floor((x - low) / span * 2**n), F.lit(0)), F.lit(2**n - 1)).cast("bigint")

    x, y = part(lon, -180.0, 360.0, n_lon), part(lat, -90.0, 180.0, n_lat)

    def bit(i: int) -> Column:
        source, place = (x, n_lon - 1 - i // 2) if i % 2 == 0 else (y, n_lat - 1 - i // 2)
        return F.shiftright(source, place).bitwiseAND(F.lit(1))

    def char(c: int) -> Column:
        value = sum((bit(5 * c + j) * 2 ** (4 - j) for j in range(5)), F.lit(0))
        return F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1))

    return F.concat(*[char(c) for c in range(precision)])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def pairs(line: Column) -> Column:
    """Neighbouring points (a, b) of a line."""
    n = F.size(line)
    return F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def is_closed(line: Column) -> Column:
    return (F.size(line) >= 4) & (F.element_at(line, 1) == F.element_at(line, -1))


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area in square degrees, as km² at the mean latitude; rings of under four points have none."""
    twice = _sum(F.transform(pairs(ring), lambda p: p["a"]["lon"] * p["b"]["lat"] - p["b"]["lon"] * p["a"]["lat"]))
    mean_lat = _sum(F.transform(ring, lambda p: p["lat"])) / F.size(ring)
    return F.when(F.size(ring) >= 4, F.abs(twice) / 2 * (KM_A_DEGREE * KM_A_DEGREE) * F.cos(F.radians(mean_lat))).otherwise(0.0)


def centroid(points: Column) -> Column:
    """Mean of the vertices; null without any."""
    n = F.size(points)
    return F.when(n > 0, F.struct((_sum(F.transform(points, lambda p: p["lat"])) / n).alias("lat"), (_sum(F.transform(points, lambda p: p["lon"])) / n).alias("lon")))


def exterior_points(polygons: Column) -> Column:
    """All vertices of the polygons' first rings."""
    return F.flatten(F.transform(polygons, lambda rings: F.get(rings, F.lit(0))))


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    crossings = F.filter(pairs(ring), lambda p: ((p["a"]["lat"] > lat) != (p["b"]["lat"] > lat)) & (lon < (p["b"]["lon"] - p["a"]["lon"]) * (lat - p["a"]["lat"]) / F.when(p["b"]["lat"] != p["a"]["lat"], p["b"]["lat"] - p["a"]["lat"]).otherwise(1.0) + p["a"]["lon"]))
    return F.size(crossings) % 2 == 1


def in_polygons(polygons: Column, lat: Column, lon: Column) -> Column:
    """Inside the first ring of a polygon and outside its others."""
    return F.exists(polygons, lambda rings: in_ring(F.get(rings, F.lit(0)), lat, lon) & ~F.exists(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda hole: in_ring(hole, lat, lon)))


def segment_fraction(a: Column, b: Column, lat: Column, lon: Column) -> Column:
    """Where on a-b, from 0 to 1, the nearest point in planar degrees lies."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    square = dx * dx + dy * dy
    return F.when(square > 0, F.least(F.greatest(((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def project(line: Column, lat: Column, lon: Column) -> Column:
    """(degrees, lat, lon, fraction) of the nearest point of a line; fraction of its planar length. The first of equals."""
    start = F.struct(F.lit(float("inf")).alias("degrees"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(0.0).alias("at"), F.lit(0.0).alias("length"))

    def step(s: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        t, size = segment_fraction(a, b, lat, lon), degree_distance(a["lat"], a["lon"], b["lat"], b["lon"])
        y, x = a["lat"] + t * (b["lat"] - a["lat"]), a["lon"] + t * (b["lon"] - a["lon"])
        d = degree_distance(lat, lon, y, x)
        better = d < s["degrees"]
        pick = lambda new, old, name: F.when(better, new).otherwise(s[old]).alias(name)
        return F.struct(pick(d, "degrees", "degrees"), pick(y, "lat", "lat"), pick(x, "lon", "lon"), pick(s["length"] + t * size, "at", "at"), (s["length"] + size).alias("length"))

    return F.aggregate(pairs(line), start, step, lambda s: F.struct(s["degrees"].alias("degrees"), s["lat"].alias("lat"), s["lon"].alias("lon"), F.when(s["length"] > 0, s["at"] / s["length"]).otherwise(0.0).alias("fraction")))


def point_at(line: Column, fraction: Column) -> Column:
    """The point at a fraction of a line's planar length."""
    lengths = F.transform(pairs(line), lambda p: degree_distance(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"]))
    target = _sum(lengths) * fraction
    start = F.struct(F.lit(0.0).alias("done"), F.element_at(line, 1).alias("point"))

    def step(s: Column, p: Column) -> Column:
        size = degree_distance(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"])
        t = F.when(size > 0, F.least(F.greatest((target - s["done"]) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        here = F.struct((p["a"]["lat"] + t * (p["b"]["lat"] - p["a"]["lat"])).alias("lat"), (p["a"]["lon"] + t * (p["b"]["lon"] - p["a"]["lon"])).alias("lon"))
        return F.struct((s["done"] + size).alias("done"), F.when(target >= s["done"], here).otherwise(s["point"]).alias("point"))

    return F.aggregate(pairs(line), start, step, lambda s: s["point"])


def thinned(line: Column, budget: int = 2000) -> Column:
    """Every k-th vertex and the last one, so that about `budget` stay."""
    n = F.size(line)
    step = F.greatest(F.ceil(n / budget), F.lit(1)).cast("int")
    return F.filter(line, lambda p, i: (i % step == 0) | (i == n - 1))


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), _coordinates(line), F.lit(")"))


def wkt_point(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def wkt_polygons(polygons: Column) -> Column:
    """POLYGON for one polygon, MULTIPOLYGON for more."""
    one = lambda rings: F.concat(F.lit("("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), _coordinates(r), F.lit(")"))), ", "), F.lit(")"))
    return F.when(F.size(polygons) == 1, F.concat(F.lit("POLYGON "), one(F.get(polygons, F.lit(0))))).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(polygons, one), ", "), F.lit(")")))


def _coordinates(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))), ", ")


def n_points(polygons: Column) -> Column:
    return F.aggregate(F.flatten(polygons), F.lit(0), lambda a, r: a + F.size(r))


def edge_parts(gid: Column) -> Column:
    """(level, tile, id) of a packed edge id: 3, 22 and 25 bits."""
    return F.struct(gid.bitwiseAND(F.lit(7)).alias("level"), F.shiftright(gid, 3).bitwiseAND(F.lit((1 << 22) - 1)).alias("tile"), F.shiftright(gid, 25).bitwiseAND(F.lit((1 << 25) - 1)).alias("id"))


def edge_id(level: Column, tile: Column, number: Column) -> Column:
    return level.cast("bigint").bitwiseOR(F.shiftleft(tile.cast("bigint"), 3)).bitwiseOR(F.shiftleft(number.cast("bigint"), 25))


def tile_base(gid: Column) -> Column:
    """Level and tile alone."""
    return gid.bitwiseAND(F.lit((1 << 25) - 1))
