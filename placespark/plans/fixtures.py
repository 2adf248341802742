"""Derived input tables, each as one SELECT over the test tables that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

D = "CAST({} AS DOUBLE)".format

SQL: dict[str, tuple[str, str]] = {
    "places": ("customer", f"""
        SELECT concat('n', c_custkey) AS osm_id, c_name AS name, {D("'29.70'")} + ((c_custkey * 7919) % 5500) / {D("'10000'")} AS lat,
          {D("'31.00'")} + ((c_custkey * 104729) % 6000) / {D("'10000'")} AS lon, CASE WHEN c_custkey % 97 = 0 THEN 8 END AS admin_level,
          (c_custkey % 13) * {D("'0.6'")} AS area_km2, ((c_custkey * 31) % 1000) / {D("'100'")} AS offline_rank, ((c_custkey * 17) % 500) / {D("'10'")} AS popularity,
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'shop' WHEN 'MACHINERY' THEN 'tourism' ELSE 'amenity' END AS category_key,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'fuel' WHEN 'BUILDING' THEN 'bank' WHEN 'FURNITURE' THEN 'furniture' WHEN 'HOUSEHOLD' THEN 'restaurant' ELSE 'hotel' END AS category_value,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'automotive' WHEN 'BUILDING' THEN 'finance' WHEN 'FURNITURE' THEN 'shopping' WHEN 'HOUSEHOLD' THEN 'food' ELSE 'lodging_tourism' END AS category_group,
          CAST(floor(c_acctbal) AS BIGINT) AS population
        FROM customer"""),
    "points": ("supplier", f"""
        SELECT s_suppkey AS p_id, {D("'29.70'")} + (((s_suppkey + 13) * 7919) % 5500) / {D("'10000'")} AS p_lat,
          {D("'31.00'")} + (((s_suppkey + 13) * 104729) % 6000) / {D("'10000'")} AS p_lon
        FROM supplier"""),
    "zone_boxes": ("nation", f"""
        SELECT concat('z', n_nationkey) AS osm_id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 6 WHEN n_nationkey % 3 = 1 THEN 8 END AS admin_level,
          {D("'100'")} + n_nationkey AS area_km2, {D("'29.70'")} + (n_nationkey % 5) * {D("'0.11'")} AS south, {D("'31.00'")} + CAST(floor(n_nationkey / 5) AS BIGINT) * {D("'0.12'")} AS west,
          {D("'29.70'")} + (n_nationkey % 5 + 1) * {D("'0.11'")} AS north, {D("'31.00'")} + (CAST(floor(n_nationkey / 5) AS BIGINT) + 1) * {D("'0.12'")} AS east
        FROM nation
        UNION ALL
        SELECT 'zall', 'whole', 4, {D("'9000'")}, {D("'29.70'")}, {D("'31.00'")}, {D("'30.25'")}, {D("'31.60'")} FROM nation WHERE n_nationkey = 0"""),
    "addresses": ("orders", f"""
        SELECT concat('a', o_orderkey) AS osm_id, o_orderkey % 2000 * 3 AS number, concat('street ', o_custkey % 50) AS street_norm,
          {D("'29.75'")} + (o_custkey % 50) * {D("'0.01'")} AS lat, {D("'31.00'")} + (o_orderkey % 2000) * {D("'0.0002'")} AS lon
        FROM orders"""),
    "line_ends": ("orders", f"""
        SELECT DISTINCT concat('w', o_custkey % 50) AS osm_id, CASE WHEN o_custkey % 50 % 4 = 3 THEN '' ELSE concat('Street ', o_custkey % 50) END AS name,
          {D("'29.75'")} + (o_custkey % 50) * {D("'0.01'")} AS a_lat, {D("'30.99'")} AS a_lon, {D("'29.75'")} + (o_custkey % 50) * {D("'0.01'")} AS b_lat, {D("'31.41'")} AS b_lon
        FROM orders"""),
    "usage_events": ("events", """
        SELECT concat('t', user_id % 10) AS tenant, concat('k', user_id) AS key_id,
          CASE event_type WHEN 'view' THEN 'geocode' WHEN 'click' THEN 'reverse' WHEN 'signup' THEN 'matrix' WHEN 'purchase' THEN 'nearby' ELSE 'autocomplete' END AS endpoint,
          CAST(CASE event_type WHEN 'signup' THEN 5000 WHEN 'error' THEN 250 ELSE 1000 END AS BIGINT) AS milli, event_id, ts
        FROM events"""),
    "edge_obs": ("events", "SELECT user_id AS gid, value AS kph, ts, event_id FROM events WHERE value > 0 AND value <= 300"),
    "route_edges": ("events", "SELECT user_id AS leg, event_id, ts, event_type AS level, value AS kph, CAST(abs(value) AS DOUBLE) AS length_m FROM events"),
    "access_log": ("pages", """
        SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat('tenant-', page_id % 4, '-key-', page_id % 7) END AS consumer, CAST(CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS INT) AS status, url AS uri
        FROM pages"""),
    "names": ("part", "SELECT concat('p', p_partkey) AS osm_id, p_name AS name, p_size / CAST('5' AS DOUBLE) AS offline_rank, (p_partkey * 37) % 101 / CAST('1' AS DOUBLE) AS popularity FROM part"),
    "corpus": ("part", f"""
        SELECT concat('p', p_partkey) AS osm_id, CASE WHEN p_partkey % 25 = 0 THEN concat(p_name, ' bank') ELSE p_name END AS name, lower(p_type) AS addr_city,
          CASE WHEN p_partkey % 3 = 0 THEN 'place' ELSE 'amenity' END AS category_key, CASE p_partkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'hotel' WHEN 2 THEN 'school' ELSE 'fuel' END AS category_value,
          CASE p_partkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'hotel' WHEN 2 THEN 'school' ELSE 'fuel' END AS category_text,
          {D("'28.00'")} + ((p_partkey * 7919) % 5500) / {D("'1000'")} AS lat, {D("'30.00'")} + ((p_partkey * 104729) % 6000) / {D("'1000'")} AS lon,
          p_size / CAST('5' AS DOUBLE) AS offline_rank, (p_partkey * 37) % 101 / CAST('1' AS DOUBLE) AS popularity
        FROM part"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or one derived from it."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, sql = SQL[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def point(lat, lon):
    return F.struct(F.col(lat).alias("lat") if isinstance(lat, str) else lat.alias("lat"), F.col(lon).alias("lon") if isinstance(lon, str) else lon.alias("lon"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_boxes with their polygons."""
    ring = F.array(point("south", "west"), point("south", "east"), point("north", "east"), point("north", "west"), point("south", "west"))
    return table(spark, sf_dir, "zone_boxes").select("osm_id", "name", "admin_level", "area_km2", F.array(F.array(ring)).alias("polygons"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "line_ends").select("osm_id", "name", F.array(point("a_lat", "a_lon"), point((F.col("a_lat") + F.col("b_lat")) / 2, (F.col("a_lon") + F.col("b_lon")) / 2), point("b_lat", "b_lon")).alias("line"))


def with_(*names: str) -> str:
    """WITH clause of derived tables for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n][1]})" for n in names)
