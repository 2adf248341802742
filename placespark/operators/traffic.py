"""Edge speeds from GPS probes, and routes coloured by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions.geo import haversine_m, tile_base
from placespark.operators.cells import nearest_lines
from placespark.operators.folds import ordered_fold

#: Smoothing, visible samples, idle seconds until a speed is forgotten, points kept of a trace, greatest speed.
ALPHA = 0.3
MIN_SAMPLES = 3
IDLE_S = 600
LAST_POINTS = 50
MOST_KPH = 300.0


def trace_points(batches: DataFrame, keep: int = LAST_POINTS) -> DataFrame:
    """Probe batches (device_id, points) as rows: the last `keep` points of each, in order."""
    last = F.slice("points", F.greatest(F.size("points") - keep + 1, F.lit(1)), F.lit(keep))
    return batches.select("device_id", F.posexplode(last).alias("pos", "p")).select("device_id", "pos", "p.*")


def plausible(observations: DataFrame) -> DataFrame:
    return observations.where((F.col("kph") > 0) & (F.col("kph") <= MOST_KPH))


def edge_means(points: DataFrame) -> DataFrame:
    """Mean observed km/h of each trace and edge; speeds are in m/s."""
    return points.where(F.col("speed").isNotNull()).groupBy("trace", "gid").agg((F.avg("speed") * 3.6).alias("kph"))


def trace_speed(points: DataFrame) -> DataFrame:
    """km/h of each trace over its consecutive fixes: metres over positive seconds; given to each of its edges."""
    before = Window.partitionBy("trace").orderBy("pos")
    rows = points.select("trace", "gid", haversine_m(F.lag("lat").over(before), F.lag("lon").over(before), F.col("lat"), F.col("lon")).alias("m"), (F.col("t") - F.lag("t").over(before)).alias("dt"))
    speed = rows.groupBy("trace").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("dt") > 0, F.col("dt"))).alias("s")).where("s > 0").select("trace", (F.col("m") / F.col("s") * 3.6).alias("kph"))
    return points.select("trace", "gid").distinct().join(speed, "trace")


def two_decimals(kph: float) -> float:
    """As a speed is kept: written with two decimals."""
    return float(f"{kph:.2f}")


def ewma(observations: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Smoothed speed of each edge in the order of (ts, event_id), kept with two decimals at each step; number of observations and last time.

    Each step rounds, so it is an ordered fold with a state of constant size: a hot edge costs its task time, not memory.
    """
    timed = observations.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))

    def step(state: tuple, kph: float, at: int) -> tuple[tuple, tuple]:
        before, n, last = state
        now = two_decimals(kph if not n else (1 - alpha) * before + alpha * kph)
        state = (now, n + 1, max(at, last))
        return state, state

    steps = ordered_fold(timed, ["gid"], ["ts", "event_id"], ["kph", "at"], "kph double, n bigint, at bigint", lambda: (0.0, 0, -(1 << 62)), step)
    last = steps.groupBy("gid").agg(F.max_by(F.struct("kph", "n", "at"), F.col("n")).alias("s"))
    return last.select("gid", "s.kph", "s.n", F.timestamp_micros("s.at").cast(observations.schema["ts"].dataType).alias("ts"))


def ewma_with_expiry(observations: DataFrame, alpha: float = ALPHA, idle_s: int = IDLE_S) -> DataFrame:
    """Like ewma, but an edge without observations for idle_s starts anew; the last run of each edge."""
    order = Window.partitionBy("gid").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if isinstance(c, str) else F.unix_micros(c.cast("timestamp")) / 1e6
    gap = seconds("ts") - seconds(F.lag("ts").over(order))
    rows = observations.withColumn("fresh", F.coalesce((gap > idle_s).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.groupBy("gid").agg(F.max("run").alias("run"))
    return ewma(rows.join(last, ["gid", "run"]), alpha)


def visible(speeds: DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    return speeds.where(F.col("n") >= least)


def congestion(live: Column, free_flow: Column) -> Column:
    ratio = live / free_flow
    return F.when(ratio >= 0.75, "free").when(ratio >= 0.5, "moderate").when(ratio >= 0.25, "slow").when(ratio.isNotNull(), "jam").otherwise("unknown")


def annotate_runs(edges: DataFrame) -> DataFrame:
    """Runs of neighbouring edges of one level in each leg, edges without length aside: first edge, edges, metres, slowest speed."""
    edges = edges.where(F.col("length_m") > 0)
    whole, own = Window.partitionBy("leg").orderBy("ts", "event_id"), Window.partitionBy("leg", "level").orderBy("ts", "event_id")
    rows = edges.withColumn("place", F.row_number().over(whole)).withColumn("island", F.col("place") - F.row_number().over(own))
    return rows.groupBy("leg", "level", "island").agg(F.min("place").alias("first_place"), F.count("*").alias("edges"), F.sum("length_m").alias("length_m"), F.min("kph").alias("slowest_kph"))


def coverage(edges: DataFrame) -> DataFrame:
    """Edges of each leg, those with a live speed, and their share in per cent."""
    rows = edges.groupBy("leg").agg(F.count("*").alias("edges"), F.count("kph").alias("live"))
    return rows.withColumn("pct", F.round(F.col("live") * 100.0 / F.col("edges"), 1))


def annotate_route(edges: DataFrame, speeds: DataFrame) -> DataFrame:
    """Edges (leg, gid, free_flow, ...) with live speed and congestion level."""
    rows = edges.join(visible(speeds).select("gid", F.col("kph").alias("live_kph")), "gid", "left")
    return rows.withColumn("level", congestion(F.col("live_kph"), F.col("free_flow")))


def uncovered_windows(edges: DataFrame, most_m: float = 2000.0) -> DataFrame:
    """Windows of edges without speed in each leg: contiguous, closed before they exceed most_m; a greedy pass in order."""

    def step(state: tuple[int, float, bool], gid: int, length_m: float, bare: bool) -> tuple[tuple, tuple | None]:
        window, m, is_open = state
        if not bare:
            return (window, 0.0, False), None
        fits = is_open and m + length_m <= most_m
        window, m = (window, m + length_m) if fits else (window + 1, length_m)
        return (window, m, True), (gid, window)

    rows = edges.withColumn("bare", F.col("live_kph").isNull()).withColumn("gid", F.col("gid").cast("bigint")).withColumn("length_m", F.coalesce(F.col("length_m").cast("double"), F.lit(0.0)))
    return ordered_fold(rows, ["leg"], ["pos"], ["gid", "length_m", "bare"], "gid bigint, window int", lambda: (-1, 0.0, False), step)


def tile_rollup(speeds: DataFrame, fresh_from: Column, shards: int = 16) -> DataFrame:
    """Edges of each tile, how many are fresh or gone back, and the tile's shard."""
    rows = speeds.groupBy(tile_base(F.col("gid")).alias("tile")).agg(F.count("*").alias("edges"), F.count_if(F.col("ts") >= fresh_from).alias("updated"), F.count_if(F.col("ts") < fresh_from).alias("reverted"))
    return rows.withColumn("shard", F.col("tile") % shards)


def sampling_grid(spark, south: float, west: float, north: float, east: float, n: int) -> DataFrame:
    """n x n points at the centres of a box's cells."""
    i = spark.range(n * n)
    return i.select((F.lit(south) + (F.floor(F.col("id") / n) + 0.5) * ((north - south) / n)).alias("lat"), (F.lit(west) + (F.col("id") % n + 0.5) * ((east - west) / n)).alias("lon"))


def once_a_window(observations: DataFrame, interval_s: int, late: int = 2) -> DataFrame:
    """One observation of each cell and interval, the first; those more than `late` intervals before the newest aside."""
    window = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / interval_s)
    rows = observations.withColumn("slot", window)
    newest = rows.agg(F.max("slot").alias("newest"))
    rows = rows.join(F.broadcast(newest)).where(F.col("slot") >= F.col("newest") - late).drop("newest")
    first = F.row_number().over(Window.partitionBy("cell", "slot").orderBy("ts", "event_id"))
    return rows.withColumn("place", first).where("place = 1").drop("place")


def edge_speed_at(points: DataFrame, roads: DataFrame, speeds: DataFrame, degrees: float = 0.005) -> DataFrame:
    """Each point's nearest road (gid, line) and its visible speed, samples and last time."""
    snapped = nearest_lines(points, roads.select("gid", "line"), "p_id", "gid", degrees).select("p_id", "gid", "distance_m")
    return points.join(snapped, "p_id", "left").join(visible(speeds), "gid", "left").select("p_id", "gid", "distance_m", "kph", "n", "ts")


def suppressed(requests: DataFrame, empties: DataFrame, seconds: int = 300) -> DataFrame:
    """Requests of windows that had no data within the last seconds left out."""
    recent = empties.select("window_id", F.col("ts").alias("empty_ts"))
    hit = (requests["window_id"] == recent["window_id"]) & recent["empty_ts"].between(requests["ts"] - F.make_dt_interval(secs=F.lit(seconds)), requests["ts"])
    return requests.join(recent, hit, "left_anti")


def within_budget(requests: DataFrame, calls_a_day: int) -> DataFrame:
    """The first calls of each day up to the budget."""
    order = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    return requests.withColumn("call", order).where(F.col("call") <= calls_a_day)
