"""Elements refined into places and addresses, and keyed upserts of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions.address import components, full_address, has_address, searchable_text
from placespark.functions.category import category_text, classify, tag
from placespark.functions.rank import offline_rank
from placespark.functions.text import normal_text, street_form


def refine_elements(elements: DataFrame) -> DataFrame:
    """Search rows of elements (osm_id, osm_type, tags, lat, lon, admin_level, area_km2): names, texts, category, rank and
    address; one projection."""
    tags = F.col("tags")
    kind, parts = classify(tags, F.col("admin_level")), components(tags)
    rows = elements.select("*", kind.alias("kind"), parts.alias("parts"))
    name = lambda key: F.coalesce(tag(tags, key), F.lit(""))
    part = lambda f: F.coalesce(F.col(f"parts.{f}"), F.lit(""))
    address = full_address(F.col("parts"))
    return rows.select(
        "osm_id", "osm_type", name("name").alias("name"), name("name:en").alias("name_en"), name("name:fr").alias("name_fr"), searchable_text(tags).alias("tags_text"), "tags", "lat", "lon",
        "admin_level", "area_km2", offline_rank(tags, F.col("admin_level"), F.col("area_km2")).alias("offline_rank"), F.lit(0.0).alias("popularity"),
        F.col("kind.key").alias("category_key"), F.col("kind.value").alias("category_value"), F.col("kind.grp").alias("category_group"), category_text(tags).alias("category_text"),
        *[part(f).alias(f"addr_{f}") for f in ("housenumber", "street", "city", "postcode", "country", "suburb", "state")],
        normal_text(address).alias("full_address"), (address != "").alias("has_address"), "parts",
    )


def address_table(elements: DataFrame) -> DataFrame:
    """Address rows of the elements with a mapped address tag; the full address as it is."""
    rows = elements.where(has_address(F.col("tags"))).select("osm_id", "osm_type", components(F.col("tags")).alias("a"), "lat", "lon")
    return rows.select("osm_id", "osm_type", "a.housenumber", "a.street", street_form(F.col("a.street")).alias("street_norm"), "a.city", "a.postcode", "a.country", full_address(F.col("a")).alias("full_address"), "lat", "lon")


def last_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def upsert_places(old: DataFrame, new: DataFrame) -> DataFrame:
    """places with the new rows in: their fields replace the old, absent ones and popularity stay; first popularity is 0."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, "osm_id", "full_outer")
    columns = ["osm_id"]
    for c in old.columns:
        if c == "popularity":
            columns.append(F.coalesce(F.col("o.popularity"), F.lit(0.0)).alias(c))
        elif c in new.columns and c != "osm_id":
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c != "osm_id":
            columns.append(F.col(f"o.{c}").alias(c))
    return joined.select(*columns)


def merge_tags(versions: DataFrame) -> DataFrame:
    """One row for each osm_id of (osm_id, version, tags): all tags, the newest value of each, with name and text anew."""
    entries = versions.select("osm_id", "version", F.explode("tags").alias("k", "v"))
    newest = entries.groupBy("osm_id", "k").agg(F.max_by("v", F.struct("version", "v")).alias("v"))
    merged = newest.groupBy("osm_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))
    return merged.select("osm_id", "tags", F.coalesce(tag(F.col("tags"), "name"), F.lit("")).alias("name"), searchable_text(F.col("tags")).alias("tags_text"))


def backfill_categories(places: DataFrame, where: Column | None = None) -> DataFrame:
    """places with their category columns derived again where asked (all by default)."""
    kind = classify(F.col("tags"), F.col("admin_level"))
    fresh = {"category_key": kind["key"], "category_value": kind["value"], "category_group": kind["grp"], "category_text": category_text(F.col("tags"))}
    where = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return places.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in fresh.items()})


def description_prompt(places: DataFrame) -> DataFrame:
    """places with prompt: what is known of a place, a line each."""
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    where = F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string"))
    return places.withColumn("prompt", F.concat_ws("\n", line("Name", F.col("name")), line("Type", F.replace("category_value", F.lit("_"), F.lit(" "))), line("Address", F.col("full_address")), line("Hours", tag(F.col("tags"), "opening_hours")), line("Coordinates", where)))
