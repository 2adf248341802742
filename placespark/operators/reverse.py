"""Reverse geocoding of points, and enrichment of places with their street and enclosing areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions.geo import distance_confidence, is_closed, ring_area_km2
from placespark.operators.cells import enclosing, nearest, nearest_lines
from placespark.operators.interpolate import reverse_interpolate

#: Planar reach of a street, and the area above which a place has none.
STREET_DEGREES = 0.005
NO_STREET_KM2 = 0.1


def areas(zones: DataFrame, lines: DataFrame) -> DataFrame:
    """zones (osm_id, name, admin_level, area_km2, polygons) and the lines (osm_id, name, line) that are closed, of four points or more:
    those are areas too. An id that is both counts once, as the zone."""
    rings = lines.where((F.size("line") >= 4) & is_closed(F.col("line"))).select("osm_id", "name", F.lit(None).cast("int").alias("admin_level"), ring_area_km2(F.col("line")).alias("area_km2"), F.array(F.array("line")).alias("polygons"))
    known = zones.select("osm_id", "name", F.col("admin_level").cast("int").alias("admin_level"), "area_km2", "polygons")
    return known.unionByName(rings.join(known.select("osm_id"), "osm_id", "left_anti"))


def with_details(found: DataFrame, places: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """found with columns of the places that its id column key names; nulls where there is none."""
    named = places.select(F.col("osm_id").alias(key), *[F.col(c).alias(f"{key.removesuffix('_id')}_{c}") for c in columns])
    return found.join(named, key, "left")


def reverse_geocode(points: DataFrame, addresses: DataFrame, lines: DataFrame, zones: DataFrame) -> DataFrame:
    """For each point (p_id, p_lat, p_lon): nearest address with metres and confidence, nearest line, and the zones
    around it, smallest first."""
    address = nearest(points, addresses.select(F.col("osm_id").alias("address_id"), "lat", "lon"), "p_id", "address_id")
    address = address.select("p_id", "address_id", F.col("distance_m").alias("address_m"), distance_confidence(F.col("distance_m")).alias("confidence"))
    line = nearest_lines(points, lines.select(F.col("osm_id").alias("line_id"), "line"), "p_id", "line_id", STREET_DEGREES).select("p_id", "line_id", F.col("distance_m").alias("line_m"))
    inside = enclosing(points, zones)
    ordered = F.array_sort(F.collect_list(F.struct("area_km2", (-F.coalesce("admin_level", F.lit(-1))).alias("level"), F.col("osm_id").alias("id"))))
    zone = inside.groupBy("p_id").agg(F.transform(ordered, lambda z: z["id"]).alias("zone_ids"))
    return points.join(address, "p_id", "left").join(line, "p_id", "left").join(zone, "p_id", "left")


def whole_reverse_geocode(points: DataFrame, addresses: DataFrame, lines: DataFrame, zones: DataFrame) -> DataFrame:
    """reverse_geocode with closed lines among the zones, the matched address's number and street, and the house number that the point itself
    would have on the street beside it: number, its street, parity and number_confidence; nulls where no numbered address is near."""
    found = reverse_geocode(points, addresses, lines.where(~is_closed(F.col("line"))), areas(zones, lines))
    named = with_details(found, addresses, "address_id", ["number", "street_norm"])
    number = reverse_interpolate(points, addresses).select("p_id", "number", "street", "parity", F.col("confidence").alias("number_confidence"))
    return named.join(number, "p_id", "left")


def needs_enrichment(places: DataFrame) -> DataFrame:
    """Places whose stored parents or street can't be right: a parent without area, the place itself, one not larger, or
    a street on a large or administrative place."""
    wrong = F.exists("parents", lambda p: p["area_km2"].isNull() | (p["osm_id"] == F.col("osm_id")) | (p["area_km2"] <= F.col("area_km2")))
    area = (F.coalesce("admin_level", F.lit(0)) > 0) | (F.col("area_km2") > NO_STREET_KM2)
    return places.where(F.col("parents").isNull() | wrong | (area & F.col("street_id").isNotNull()))


def enrich_places(places: DataFrame, lines: DataFrame, zones: DataFrame, k: int = 10) -> DataFrame:
    """places with street_id (first named line of the k nearest; none for administrative or large places) and parents
    (named zones around the centroid that are larger, smallest first, then higher level)."""
    points = places.select(F.col("osm_id").alias("place_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("area_km2").alias("own_area"), "admin_level")
    small = points.where((F.coalesce("admin_level", F.lit(0)) <= 0) & (F.coalesce("own_area", F.lit(0.0)) <= NO_STREET_KM2)).drop("admin_level")
    near = nearest_lines(small, lines.select(F.col("osm_id").alias("line_id"), "line"), "place_id", "line_id", STREET_DEGREES, k)
    named = near.join(lines.where("name <> ''").select(F.col("osm_id").alias("line_id"), F.col("name").alias("street_name")), "line_id")
    street = named.groupBy("place_id").agg(F.min_by(F.col("line_id"), F.col("rank")).alias("street_id"))
    inside = enclosing(points.drop("admin_level"), zones.where("name <> ''").select("osm_id", "name", "admin_level", "area_km2", "polygons"))
    inside = inside.where((F.col("area_km2") > F.coalesce("own_area", F.lit(0.0))) & (F.col("osm_id") != F.col("place_id"))).dropDuplicates(["place_id", "osm_id"])
    ordered = F.array_sort(F.collect_list(F.struct("area_km2", (-F.coalesce("admin_level", F.lit(-1))).alias("level"), "osm_id", "name", "admin_level")))
    parents = inside.groupBy("place_id").agg(F.transform(ordered, lambda z: F.struct(z["osm_id"].alias("osm_id"), z["name"].alias("name"), z["admin_level"].alias("admin_level"), z["area_km2"].alias("area_km2"))).alias("parents"))
    keyed = F.col("osm_id") == F.col("place_id")
    return places.drop("street_id", "parents").join(street, keyed, "left").drop("place_id").join(parents, keyed, "left").drop("place_id")


def first_with_number(results: DataFrame) -> DataFrame:
    """Of each point's provider results the first with number and street, else the first; by distance, unknown last."""
    full = F.col("housenumber").isNotNull() & F.col("street").isNotNull()
    order = Window.partitionBy("p_id").orderBy(full.desc(), F.col("distance_m").asc_nulls_last(), "pos")
    return results.withColumn("has_full", full).withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick")
