"""Places around points by category: filters, scores, sorting and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions.geo import gauss_decay
from placespark.intermediate import written
from placespark.operators.cells import folded, spot_pairs

#: What is too large or too high to be a point of interest.
MOST_KM2 = 5.0
AREAS = ["place", "boundary"]
#: Steps of a score of 1, and rings of a circle, by which places are counted; what rounding to six digits can change.
STEPS, RINGS, MARGIN = 32, 64, 2e-6


def log1p10(x: Column) -> Column:
    return F.log10(F.lit(1.0) + F.coalesce(x, F.lit(0.0)))


def points_of_interest(places: DataFrame) -> DataFrame:
    """places without boundaries, large areas and area groups; unknown values stay."""
    excluded = (F.col("admin_level") > 0) | (F.col("area_km2") > MOST_KM2) | F.col("category_group").isin(AREAS)
    return places.where(~F.coalesce(excluded, F.lit(False)))


def wanted(values: str | list[str] | None) -> list[str]:
    """Distinct values of a parameter that may be a list, comma-separated or both."""
    given = [values] if isinstance(values, str) else values or []
    return list(dict.fromkeys(v.strip() for x in given for v in x.split(",") if v.strip()))


def within_box(places: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return places.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def best_score(radius_m: float) -> Column:
    return log1p10(F.col("offline_rank")) * 1.5 + gauss_decay(F.col("distance_m"), max(radius_m / 3, 100.0)) * 2.0 + log1p10(F.col("popularity"))


def _foremost(places: DataFrame, order: Column, value: Column, k: int) -> DataFrame:
    """Of the places at each spot those that can be among the k first at any distance; n: how many there were."""
    spot = Window.partitionBy("lat", "lon")
    rows = places.withColumns({"n": F.count("*").over(spot), "at": F.row_number().over(spot.orderBy(order, "osm_id")), "value": value})
    rows = rows.withColumn("last", F.max(F.when(F.col("at") == k, F.col("value"))).over(spot))
    return rows.where((F.col("at") <= k) | (F.col("value") >= F.col("last") - MARGIN)).drop("at", "value", "last")


def nearby(points: DataFrame, places: DataFrame, radius_m: float, *, categories: str | list[str] | None = None, groups: str | list[str] | None = None,
           sort: str = "best", limit: int = 20, offset: int = 0, after: tuple[float, str] | None = None) -> DataFrame:
    """For each point (p_id, p_lat, p_lon) the places within radius_m: score, rank, total, has_more.

    sort "best" goes by score, highest first, "distance" by metres; ties by osm_id. after is the last page's last (score
    or distance, osm_id); offset skips rows instead.

    The places around a point are gone through twice. First they are counted by steps of the key, which gives the total and a bound
    that offset + limit of them reach; then those within the bound are sorted. Points at one spot are one here, and of the places at
    one spot only those travel that can be on the page.
    """
    near = points_of_interest(places)
    if values := wanted(categories):
        near = near.where(F.col("category_value").isin(values))
    if values := wanted(groups):
        near = near.where(F.col("category_group").isin(values))
    near, k, best = written(near.withColumn("row", F.monotonically_increasing_id())), offset + limit, sort == "best"
    parts = near.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", "row", "osm_id", (log1p10(F.col("offline_rank")) * 1.5).alias("a"), log1p10(F.col("popularity")).alias("c"))
    if after:
        some = parts.withColumn("n", F.count("*").over(Window.partitionBy("lat", "lon")))
    else:
        own = F.coalesce(F.col("a") + F.col("c"), F.lit(-1e300)) if best else F.lit(0.0)
        some = _foremost(parts, own.desc(), own, k) if best else _foremost(parts, F.lit(0), F.when(F.lit(False), 0.0), k)
    # n is the spot's, so it is counted with one of its rows
    held = written(folded(some.withColumn("n", F.when(F.row_number().over(Window.partitionBy("lat", "lon").orderBy("row")) == 1, F.col("n")).otherwise(0)), ["lat", "lon"], "rows"))
    spots = points.select("p_lat", "p_lon").distinct()
    pairs = spot_pairs(spots, held, radius_m, point_has_cells=False)
    nearness = gauss_decay(F.col("distance_m"), max(radius_m / 3, 100.0)) * 2.0
    each = pairs.withColumn("g", nearness if best else F.lit(0.0)).select("p_lat", "p_lon", "distance_m", "g", F.explode("rows").alias("r")).select("p_lat", "p_lon", "distance_m", F.col("r.row").alias("row"), F.col("r.osm_id").alias("osm_id"), F.col("r.n").alias("n"), (F.col("r.a") + F.col("g") + F.col("r.c")).alias("raw"))
    # the key from its best end upwards
    up = F.coalesce(-F.col("raw"), F.lit(1e300)) if best else F.col("distance_m")
    begin = -after[0] if after and best else after[0] if after else None
    step = F.floor(F.greatest(F.least(up, F.lit(1e9)), F.lit(-1e9)) * STEPS) if best else F.floor(F.pow(up / radius_m, 2) * RINGS)
    surely = up > begin + MARGIN if after else F.lit(True)
    counts = written(each.groupBy("p_lat", "p_lon", step.alias("step")).agg(F.sum("n").alias("n"), F.count_if(surely).alias("on_page")))
    totals = counts.groupBy("p_lat", "p_lon").agg(F.sum("n").alias("total"))
    so_far = F.sum("on_page").over(Window.partitionBy("p_lat", "p_lon").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = counts.withColumn("so_far", so_far).where(F.col("so_far") >= k).groupBy("p_lat", "p_lon").agg(F.min("step").alias("step"))
    most = (F.col("step") + 1) / STEPS if best else F.sqrt((F.col("step") + 1) / RINGS) * radius_m
    bounds = written(totals.join(steps, ["p_lat", "p_lon"], "left").select("p_lat", "p_lon", "total", F.coalesce(most + MARGIN + F.abs(most) * 1e-9, F.lit(float("inf"))).alias("most")))
    again = spot_pairs(bounds, held, radius_m, point_has_cells=False)
    within = F.col("distance_m") <= F.col("most") if not best else F.lit(True)
    again = again.where(within).withColumn("g", nearness if best else F.lit(0.0)).select("p_lat", "p_lon", "total", "most", "distance_m", "g", F.explode("rows").alias("r"))
    again = again.select("p_lat", "p_lon", "total", "most", "distance_m", F.col("r.row").alias("row"), F.col("r.osm_id").alias("osm_id"), (F.col("r.a") + F.col("g") + F.col("r.c")).alias("raw"))
    again = again.where((up <= F.col("most")) & (up >= begin - MARGIN if after else F.lit(True))).drop("most")
    key = F.round("raw", 6) if best else F.round("distance_m", 6)
    found = again.withColumn("key", key)
    if after:
        value, osm_id = after
        beyond = F.col("key") < value if best else F.col("key") > value
        found = found.where(beyond | ((F.col("key") == value) & (F.col("osm_id") > osm_id)))
    order = [F.col("key").desc() if best else F.col("key").asc(), F.col("osm_id")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("p_lat", "p_lon").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "raw", "total")
    whole = points.join(totals, ["p_lat", "p_lon"]).withColumn("total", F.sum("total").over(Window.partitionBy("p_id")))
    rows = whole.join(found, ["p_lat", "p_lon"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("p_id").orderBy(*order))).where((F.col("rank") > offset) & (F.col("rank") <= k))
    rows = rows.drop("key", "osm_id").join(near, "row").drop("row").withColumn("score", F.round(best_score(radius_m), 6))
    return rows.select(*points.columns, *places.columns, "distance_m", "score", "total", "rank", (F.col("total") > k).alias("has_more"))
