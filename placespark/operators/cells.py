"""Spatial joins by grid cells: an equi-join on cells first, the exact test after; never all pairs.

A row of the grid is `step` degrees of latitude high; its cells are as wide as that at the row's latitude, so that their
number falls towards the poles, and they wrap around at 180 degrees. The side with reach is exploded into the cells its
circle or box touches; the other is in one cell. Hot cells are left to adaptive skew joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions.geo import EARTH_M, degree_distance, haversine_m, in_polygons, pairs, segment_fraction
from placespark.intermediate import written

METRES_A_DEGREE = EARTH_M * 3.141592653589793 / 180
COARSE = 64


def grid_row(lat: Column, step: float) -> Column:
    return F.floor((lat + 90) / step).cast("int")


def _cells_in_row(row: Column, step: float) -> Column:
    """How many cells a row has: by its edge nearer to the equator, so that none is narrower than step there."""
    low = F.abs(row * step - 90)
    edge = F.least(low, F.abs((row + 1) * step - 90))
    return F.greatest(F.floor(360 / step * F.cos(F.radians(F.least(edge, F.lit(90.0))))), F.lit(1)).cast("bigint")


def cell(row: Column, lon: Column, step: float) -> Column:
    n = _cells_in_row(row, step)
    return F.pmod(F.floor((lon + 180) / 360 * n), n) * F.lit(1 << 24) + row


def home_cell(lat: Column, lon: Column, step: float) -> Column:
    return cell(grid_row(lat, step), lon, step)


def cells_of_box(south: Column, west: Column, north: Column, east: Column, step: float) -> Column:
    """All cells that a box touches."""
    rows = F.sequence(grid_row(south, step), grid_row(north, step))

    def row_cells(row: Column) -> Column:
        n = _cells_in_row(row, step)
        first, last = F.floor((west + 180) / 360 * n), F.floor((east + 180) / 360 * n)
        return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: F.pmod(c, n) * F.lit(1 << 24) + row)

    return F.array_distinct(F.flatten(F.transform(rows, row_cells)))


def _circle_box(lat: Column, lon: Column, metres: Column | float) -> tuple[Column, Column, Column, Column]:
    up = (metres if isinstance(metres, Column) else F.lit(float(metres))) / METRES_A_DEGREE * 1.0000001
    worst = F.greatest(F.abs(lat - up), F.abs(lat + up))
    wide = F.when(worst >= 89.999, 180.0).otherwise(F.least(up / F.cos(F.radians(worst)), F.lit(180.0)))  # a circle over a pole has all longitudes
    return F.greatest(lat - up, F.lit(-90.0)), lon - wide, F.least(lat + up, F.lit(90.0)), lon + wide


#: Rows at one spot that travel as one.
FOLD = 256


def folded(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows that are equal in keys as one, with an array name of their other columns, up to FOLD of them each."""
    rest = [c for c in rows.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(F.lit(0))
    part = rows.withColumn("part", F.floor((F.row_number().over(order) - 1) / FOLD))
    return part.groupBy(*keys, "part").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("part") if rest else rows.select(*keys, F.array(F.struct(F.lit(0).alias("none"))).alias(name))


def unfolded(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return rows.select("*", F.explode(name).alias("one")).drop(name).select("*", *[F.col("one")[c].alias(c) for c in columns]).drop("one")


def spot_pairs(points: DataFrame, places: DataFrame, metres: float, also: list[str] | None = None, point_has_cells: bool = True) -> DataFrame:
    """Rows of points (p_lat, p_lon) and places (lat, lon) within metres, with distance_m. One side is copied to the cells that its circle
    touches: points, or else places; then all places of a point meet it in one task."""
    step = max(metres / 2 / METRES_A_DEGREE, 1e-4)
    reach = lambda lat, lon: F.explode(cells_of_box(*_circle_box(F.col(lat), F.col(lon), metres), step))
    home = lambda lat, lon: home_cell(F.col(lat), F.col(lon), step)
    own, held = (reach, home) if point_has_cells else (home, reach)
    n, on = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["cell", *(also or [])]
    dealt = points.withColumn("cell", own("p_lat", "p_lon")).repartition(n, *on)
    joined = dealt.join(places.withColumn("cell", held("lat", "lon")).hint("shuffle_merge"), on).drop("cell").where(F.abs(F.col("p_lat") - F.col("lat")) <= metres / METRES_A_DEGREE * 1.0000001)
    return joined.withColumn("distance_m", haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).where(F.col("distance_m") <= metres)


def radius_pairs(points: DataFrame, places: DataFrame, metres: float, also: list[str] | None = None) -> DataFrame:
    """radius_join with points at one spot, and places at one, still as one row; what goes by the distance is worked out once for them all."""
    on = also or []
    return spot_pairs(folded(points, [*on, "p_lat", "p_lon"], "at_point"), folded(places, [*on, "lat", "lon"], "at_place"), metres, also)


def apart(pairs: DataFrame, points: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of radius_pairs with each point and place as a row of its own."""
    keys = [c for c in pairs.columns if c not in ("at_point", "at_place")]
    pairs = unfolded(pairs, "at_point", [c for c in points.columns if c not in keys])
    return unfolded(pairs, "at_place", [c for c in places.columns if c not in keys])


def radius_join(points: DataFrame, places: DataFrame, metres: float, also: list[str] | None = None) -> DataFrame:
    """points (p_lat, p_lon) with every place (lat, lon) within metres, of equal columns also, and distance_m."""
    on = also or []
    order = [*on, *[c for c in points.columns if c not in on], *[c for c in places.columns if c not in on]]
    return apart(radius_pairs(points, places, metres, also), points, places).select(*order, "distance_m")


def degree_join(points: DataFrame, places: DataFrame, degrees: float) -> DataFrame:
    """points (p_lat, p_lon) with every place (lat, lon) within degrees of planar distance, and it."""
    reach = points.withColumn("cell", F.explode(cells_of_box(F.col("p_lat") - degrees, F.col("p_lon") - degrees, F.col("p_lat") + degrees, F.col("p_lon") + degrees, degrees)))
    held = places.withColumn("cell", home_cell(F.col("lat"), F.col("lon"), degrees))
    joined = reach.join(held, "cell").drop("cell").withColumn("degrees", degree_distance(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    return joined.where(F.col("degrees") <= degrees)


def _levels(first_m: float) -> list[float]:
    """Cell sizes in metres, each four times the one before, up to one that spans the globe."""
    sizes = [first_m]
    while sizes[-1] < EARTH_M * 3.15:
        sizes.append(sizes[-1] * 4)
    return sizes


def _best(found: DataFrame, point_id: str, place_id: str, k: int) -> DataFrame:
    """The k nearest of each point's candidates, with rank."""
    if k == 1:
        kept = [c for c in found.columns if c not in (point_id, "distance_m", place_id)]
        best = found.groupBy(point_id).agg(F.min_by(F.struct("distance_m", place_id, *kept), F.struct("distance_m", place_id)).alias("best"))
        return best.select(point_id, "best.*", F.lit(1).alias("rank"))
    order = Window.partitionBy(point_id).orderBy("distance_m", place_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _step(metres: float) -> float:
    return max(metres / METRES_A_DEGREE, 1e-4)


def _of(values: list[float], level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), level + 1)


def _homes(lat: Column, lon: Column, levels: dict[int, float]) -> Column:
    """(level, cell) of a place at several levels."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("level"), home_cell(lat, lon, _step(m)).alias("cell")) for i, m in levels.items()]))


def point_levels(points: DataFrame, counts: DataFrame, point_id: str, k: int, sizes: list[float], also: list[str] | None = None) -> DataFrame:
    """points with level: the size of cells to look in for k places, by counts of places in cells of all sizes.

    The smallest cell around a point that holds k gives a level; the one below it does if the cells that a circle of its size touches
    hold k. This only guides the search: any level gives right results.
    """
    on = also or []
    around = points.select(point_id, *on, _homes(F.col("p_lat"), F.col("p_lon"), dict(enumerate(sizes))).alias("at")).select(point_id, *on, "at.*")
    around = around.join(counts.where(F.col("n") >= k), ["level", "cell", *on]).groupBy(point_id).agg(F.min("level").alias("own"))
    own = written(points.join(around, point_id, "left").withColumn("own", F.coalesce("own", F.lit(len(sizes) - 1))))
    below = F.greatest(F.col("own") - 1, F.lit(0))
    touched = own.select(point_id, *on, below.alias("level"), F.explode(cells_of_box(*_circle_box(F.col("p_lat"), F.col("p_lon"), _of(sizes, below)), _of([_step(m) for m in sizes], below))).alias("cell"))
    near = touched.join(counts, ["level", "cell", *on]).groupBy(point_id).agg(F.sum("n").alias("n")).where(F.col("n") >= k).select(point_id, F.lit(True).alias("near"))
    return own.join(near, point_id, "left").withColumn("level", F.when(F.col("near"), below).otherwise(F.col("own"))).drop("own", "near")


def _bounds(asked: DataFrame, counts: DataFrame, point_id: str, k: int, sizes: list[float], also: list[str] | None = None) -> DataFrame:
    """(point_id, bound): the k-th nearest place isn't further away.

    Of the cells two sizes below a point's level that stand in its own cells and hold k places, each bounds it: by the distance of the
    middle of the places' box, half the box's height, and half its width. Without one the point's own cells do, as they hold k.
    """
    centre = ((F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2)
    steps, parts = [_step(m) for m in sizes], []
    for fine in range(len(sizes)):
        for level in range(3) if fine == 0 else [fine + 2] if fine + 2 < len(sizes) else []:
            parts.append(F.struct(F.lit(fine).alias("fine"), F.lit(level).alias("level")))
    across = F.cos(F.radians(F.when((F.col("south") < 0) & (F.col("north") > 0), 0.0).otherwise(F.least(F.abs("south"), F.abs("north")))))
    half = F.radians((F.col("north") - F.col("south")) / 2 + (F.col("east") - F.col("west")) / 2 * across) * EARTH_M
    on = also or []
    boxes = counts.where(F.col("n") >= k).select(*on, *[c.alias(n) for c, n in zip((*centre, half), ("lat", "lon", "half"), strict=True)], F.col("level").alias("own"), F.explode(F.array(*parts)).alias("part")).where("own = part.fine")
    boxes = boxes.select(*on, "lat", "lon", "half", F.col("part.level").alias("level"), home_cell(F.col("lat"), F.col("lon"), _of(steps, F.col("part.level"))).alias("cell"))
    reach = asked.withColumn("cell", F.explode(cells_of_box(*_circle_box(F.col("p_lat"), F.col("p_lon"), _of(sizes, F.col("level"))), _of(steps, F.col("level")))))
    found = reach.join(boxes, ["level", "cell", *on]).groupBy(point_id).agg(F.min(haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) + F.col("half")).alias("bound"))
    globe = EARTH_M * 3.15
    own = F.when(F.col("level") == len(sizes) - 1, globe).otherwise(F.least(_of(sizes, F.col("level")) * 8, F.lit(globe)))
    return asked.join(found, point_id, "left").withColumn("bound", F.least(F.coalesce("bound", own), own) * 1.000001 + 0.001)


def nearest(points: DataFrame, places: DataFrame, point_id: str, place_id: str, k: int = 1, first_m: float = 30.0, also: list[str] | None = None) -> DataFrame:
    """The k nearest places (place_id, lat, lon) of every point (point_id, p_lat, p_lon and more): distance_m and rank; ties to the smaller id.
    With also, of those that are equal in these columns.

    Places at one spot count as its k smallest ids. Counts of places by cells of several sizes say where to look and bound how far the
    k-th nearest can be (point_levels, _bounds); each point then meets, once, the places in the cells that the circle of its bound
    touches, of the smallest cells that are at least an eighth as wide as the bound. Points without coordinates, or places without, have no
    part; fewer than k places give fewer rows; no places, no rows.
    """
    sizes, on = _levels(first_m), also or []
    own = places.where("lat IS NOT NULL AND lon IS NOT NULL").select(*on, place_id, "lat", "lon")
    spots = own.groupBy(*on, "lat", "lon").agg(F.min(place_id).alias(place_id)) if k == 1 else own.withColumn("at", F.row_number().over(Window.partitionBy(*on, "lat", "lon").orderBy(place_id))).where(F.col("at") <= k).drop("at")
    spots = written(spots)
    box = [f(c).alias(n) for f, c, n in ((F.min, "lat", "south"), (F.max, "lat", "north"), (F.min, "lon", "west"), (F.max, "lon", "east"))]
    counts = spots.select(*on, "lat", "lon", _homes(F.col("lat"), F.col("lon"), dict(enumerate(sizes))).alias("at")).select(*on, "lat", "lon", "at.*")
    counts = written(counts.groupBy(*on, "level", "cell").agg(F.count("*").alias("n"), *box))
    asked = point_levels(points.where("p_lat IS NOT NULL AND p_lon IS NOT NULL"), counts, point_id, k, sizes, on)
    asked = _bounds(asked, counts, point_id, k, sizes, on)
    level = F.coalesce(*[F.when(F.lit(m) * 8 >= F.col("bound"), i) for i, m in enumerate(sizes)], F.lit(len(sizes) - 1))
    asked = written(asked.withColumn("level", level))
    used = sorted(r[0] for r in asked.select("level").distinct().collect())
    reach = asked.withColumn("cell", F.explode(cells_of_box(*_circle_box(F.col("p_lat"), F.col("p_lon"), F.col("bound")), _of([_step(m) for m in sizes], F.col("level")))))
    held = spots.select(*on, place_id, "lat", "lon", _homes(F.col("lat"), F.col("lon"), {i: sizes[i] for i in used or [0]}).alias("at")).select(*on, place_id, "lat", "lon", "at.*")
    found = reach.join(held, ["level", "cell", *on]).drop("cell", "level").withColumn("distance_m", haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    return _best(found.where(F.col("distance_m") <= F.col("bound")).drop("bound"), point_id, place_id, k)


def segments(lines: DataFrame, line: str = "line") -> DataFrame:
    """A row for each segment of the lines: a, b and its place."""
    return lines.select("*", F.posexplode(pairs(F.col(line))).alias("segment", "ab")).select("*", F.col("ab.a").alias("a"), F.col("ab.b").alias("b")).drop("ab")


def nearest_lines(points: DataFrame, lines: DataFrame, point_id: str, line_id: str, degrees: float = 0.005, k: int = 1) -> DataFrame:
    """The k nearest lines within degrees of each point (planar), with degrees, the nearest point and distance_m."""
    parts = segments(lines.select(line_id, "line"))
    boxes = cells_of_box(F.least("a.lat", "b.lat") - degrees, F.least("a.lon", "b.lon") - degrees, F.greatest("a.lat", "b.lat") + degrees, F.greatest("a.lon", "b.lon") + degrees, degrees * 2)
    held = parts.withColumn("cell", F.explode(boxes)).drop("line")
    joined = points.withColumn("cell", home_cell(F.col("p_lat"), F.col("p_lon"), degrees * 2)).join(held, "cell")
    t = segment_fraction(F.col("a"), F.col("b"), F.col("p_lat"), F.col("p_lon"))
    near = joined.withColumn("near_lat", F.col("a.lat") + t * (F.col("b.lat") - F.col("a.lat"))).withColumn("near_lon", F.col("a.lon") + t * (F.col("b.lon") - F.col("a.lon")))
    near = near.withColumn("degrees", degree_distance(F.col("p_lat"), F.col("p_lon"), F.col("near_lat"), F.col("near_lon"))).where(F.col("degrees") <= degrees)
    best = near.groupBy(point_id, line_id).agg(F.min(F.struct("degrees", "segment", "near_lat", "near_lon", "p_lat", "p_lon")).alias("best"))
    rank = F.row_number().over(Window.partitionBy(point_id).orderBy("degrees", line_id))
    best = best.select(point_id, line_id, "best.*").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("distance_m", haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("near_lat"), F.col("near_lon")))


def enclosing(points: DataFrame, zones: DataFrame, step: float = 0.1) -> DataFrame:
    """points (p_lat, p_lon) with every zone (polygons) that holds them; very large boxes live in a coarser grid."""
    vertices = F.flatten(F.flatten("polygons"))
    lat, lon = F.transform(vertices, lambda p: p["lat"]), F.transform(vertices, lambda p: p["lon"])
    boxed = zones.select("*", F.array_min(lat).alias("south"), F.array_min(lon).alias("west"), F.array_max(lat).alias("north"), F.array_max(lon).alias("east"))
    large = (F.col("north") - F.col("south") > step * COARSE) | (F.col("east") - F.col("west") > step * COARSE)
    out = None
    for own, size in ((~large, step), (large, step * COARSE)):
        held = boxed.where(own).withColumn("cell", F.explode(cells_of_box(F.col("south"), F.col("west"), F.col("north"), F.col("east"), size))).drop("south", "west", "north", "east")
        joined = points.withColumn("cell", home_cell(F.col("p_lat"), F.col("p_lon"), size)).join(held, "cell").drop("cell")
        joined = joined.where(in_polygons(F.col("polygons"), F.col("p_lat"), F.col("p_lon")))
        out = joined if out is None else out.unionByName(joined)
    return out
