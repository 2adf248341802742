"""Queries over usage, traffic, retrieval results and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placespark.intermediate import shared_folder
from placespark.operators import evaluate, metering, traffic
from placespark.plans.fixtures import lines, table, with_
from placespark.streaming import jobs

#: An edge's list of speeds folded as it is kept, with two decimals.
SMOOTHED = "list_reduce(list_prepend(CAST(printf('%.2f', v[1]) AS DOUBLE), v[2:]), lambda a, x: CAST(printf('%.2f', (1 - 0.3::DOUBLE) * a + 0.3::DOUBLE * x) AS DOUBLE))"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stamped(df: DataFrame) -> DataFrame:
    """Times of the test tables have no zone; streams and epochs need one."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


ROLLUP = f"{with_('usage_events')}, r AS (SELECT tenant, key_id, strftime(ts, '%Y-%m') AS period, CAST(ts AS DATE) AS day, endpoint, CAST(sum(milli) AS BIGINT) AS milli, count(*) AS requests FROM usage_events GROUP BY ALL)"


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.rollup(table(spark, sf_dir, "usage_events"))


@query(ROLLUP + " SELECT tenant, key_id, period, day, endpoint, milli, requests FROM r")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups(spark, sf_dir)


@query(ROLLUP + " SELECT period, day, endpoint, CAST(sum(milli) AS BIGINT) AS milli, CAST(sum(requests) AS BIGINT) AS requests FROM r WHERE period BETWEEN '2024-01' AND '2024-12' GROUP BY ALL")
def usage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.history(rollups(spark, sf_dir), "2024-01", "2024-12")


@query(ROLLUP + ", p AS (SELECT min(period) AS p FROM r) SELECT concat('t', n_nationkey) AS tenant, CAST(coalesce(sum(milli), 0) AS BIGINT) AS milli, CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests FROM nation LEFT JOIN r ON r.tenant = concat('t', n_nationkey) AND period = (SELECT p FROM p) GROUP BY 1")
def tenant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollups(spark, sf_dir)
    first = r.agg(F.min("period")).first()[0] or ""
    return metering.tenant_totals(r, tenants(spark, sf_dir), first)


@query(ROLLUP + ", p AS (SELECT min(period) AS p FROM r) SELECT concat('k', c_custkey) AS key_id, CAST(coalesce(sum(milli), 0) AS BIGINT) AS milli, CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests FROM customer LEFT JOIN r ON r.key_id = concat('k', c_custkey) AND period = (SELECT p FROM p) GROUP BY 1")
def key_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollups(spark, sf_dir)
    first = r.agg(F.min("period")).first()[0] or ""
    return metering.key_usage(r, table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey")).alias("key_id")), first)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), n).alias("tenant"), F.concat(F.lit("plan"), n % 3).alias("plan"), F.when(n % 7 == 0, "deleted").otherwise("active").alias("status"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plans by region keys."""
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.concat(F.lit("plan"), k).alias("plan"), (k * 2900).alias("base_cents"), (k * 50 + 10).cast("double").alias("quota"), (k * 0.25 + 0.5).alias("overage_cents"))


@query(ROLLUP + """, t AS (SELECT concat('t', n_nationkey) AS tenant, n_nationkey % 3 AS k FROM nation), m AS (SELECT tenant, CAST(sum(milli) AS BIGINT) AS milli FROM r GROUP BY 1)
SELECT tenant, concat('plan', k) AS plan, milli, CAST(k * 2900 + ceil(greatest(milli / 1000.0::DOUBLE - (k * 50 + 10), 0) * (k * 0.25::DOUBLE + 0.5)) AS BIGINT) AS total_cents FROM t JOIN m USING (tenant)""")
def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rollups(spark, sf_dir).groupBy("tenant").agg(F.sum("milli").alias("milli"), F.sum("requests").alias("requests"))
    return metering.invoices(totals, tenants(spark, sf_dir), plans(spark, sf_dir)).select("tenant", "plan", "milli", "total_cents")


@query("SELECT concat('plan', n_nationkey % 3) AS plan, count(*) AS tenants FROM nation WHERE n_nationkey % 7 <> 0 GROUP BY 1")
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.plan_counts(tenants(spark, sf_dir))


@query(f"{with_('usage_events')} SELECT tenant, date_trunc('second', ts) AS second, count(*) AS requests, count(*) > 1 AS over_limit FROM usage_events GROUP BY ALL")
def request_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metering.bursts(table(spark, sf_dir, "usage_events"), 1)
    return rows.withColumn("second", F.col("second").cast("timestamp_ntz"))


@query(f"""{with_('usage_events').replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT tenant, strftime(ts, '%Y-%m') AS period, event_id, milli, row_number() OVER (PARTITION BY tenant, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n FROM usage_events),
r AS (SELECT tenant, period, n, event_id, milli <= 20000 AS accepted, CASE WHEN milli <= 20000 THEN CAST(milli AS BIGINT) ELSE 0 END AS used FROM e WHERE n = 1
UNION ALL SELECT e.tenant, e.period, e.n, e.event_id, r.used + e.milli <= 20000, CASE WHEN r.used + e.milli <= 20000 THEN r.used + e.milli ELSE r.used END FROM r JOIN e ON e.tenant = r.tenant AND e.period = r.period AND e.n = r.n + 1)
SELECT tenant, period, event_id, accepted, used FROM r""")
def quota_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.quota_replay(table(spark, sf_dir, "usage_events"), 20_000)


@query(f"""{with_('access_log')}, s AS (SELECT page_id, regexp_replace(regexp_extract(uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS path, consumer, status FROM access_log)
SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END AS path, regexp_extract(path, '^/?([^/]*)', 1) AS endpoint, nullif(regexp_extract(consumer, '-key-([^-]+)$', 1), '') AS key_id FROM s WHERE consumer IS NOT NULL AND status < 400 AND CASE WHEN path = '' THEN '/' ELSE path END NOT IN ('/health', '/metrics', '/docs', '/openapi.json', '/nearby/categories')""")
def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metering.served(table(spark, sf_dir, "access_log"))
    return rows.select("page_id", metering.url_path(F.col("uri")).alias("path"), metering.endpoint(F.col("uri")).alias("endpoint"), metering.key_of_consumer(F.col("consumer")).alias("key_id"))


@query(f"""{with_('usage_events')}, w AS (SELECT * FROM (VALUES ('matrix', 5000), ('reverse', 500)) t(endpoint, weight_milli)) SELECT event_id, concat('plan', n_nationkey % 3) AS plan, CAST(coalesce(weight_milli, 1000) AS INTEGER) AS weight_milli FROM usage_events JOIN nation ON tenant = concat('t', n_nationkey) LEFT JOIN w USING (endpoint)""")
def weighted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([("matrix", 5000), ("reverse", 500)], "endpoint string, weight_milli int")
    events = table(spark, sf_dir, "usage_events")
    keys = events.select("key_id", "tenant").distinct()
    rows = metering.joined_keys(events.drop("tenant"), keys, tenants(spark, sf_dir), plans(spark, sf_dir), weights)
    return rows.select("event_id", "plan", "weight_milli")


@query("""WITH o AS (SELECT o_custkey AS tenant, CASE WHEN o_custkey % 3 = 0 THEN 'paid' ELSE 'pending' END AS status, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_custkey % 2 = 0 OR o_custkey % 3 = 0 GROUP BY 1, 2),
n AS (SELECT o_custkey AS tenant, 'pending' AS status, CAST(count(*) AS BIGINT) AS total FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1)
SELECT tenant, CASE WHEN o.status = 'paid' OR n.status IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN o.status = 'paid' OR n.status IS NULL THEN o.total ELSE n.total END AS total FROM o FULL JOIN n USING (tenant)""")
def invoice_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant"), "o_orderkey").withColumn("period", F.lit("2024-01"))
    old = o.where("tenant % 2 = 0 OR tenant % 3 = 0").groupBy("tenant", "period").agg(F.sum("o_orderkey").alias("total")).withColumn("status", F.when(F.col("tenant") % 3 == 0, "paid").otherwise("pending"))
    new = o.where("tenant % 5 <> 0").groupBy("tenant", "period").agg(F.count("*").alias("total")).withColumn("status", F.lit("pending"))
    return metering.upsert_invoices(old, new.select(*old.columns)).select("tenant", "status", "total")


@query(f"{with_('edge_obs')}, l AS (SELECT gid, list(kph ORDER BY ts, event_id) AS v, max(ts) AS ts FROM edge_obs GROUP BY gid) SELECT gid, round({SMOOTHED}, 6) AS kph, CAST(len(v) AS BIGINT) AS n FROM l")
def edge_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.ewma(table(spark, sf_dir, "edge_obs")).select("gid", F.round("kph", 6).alias("kph"), "n")



@query(f"""{with_('edge_obs')}, g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY gid ORDER BY ts, event_id)) > 86400 THEN 1 ELSE 0 END AS fresh FROM edge_obs),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY gid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g), m AS (SELECT *, max(run) OVER (PARTITION BY gid) AS last_run FROM r),
l AS (SELECT gid, list(kph ORDER BY ts, event_id) AS v FROM m WHERE run = last_run GROUP BY gid) SELECT gid, round({SMOOTHED}, 6) AS kph, CAST(len(v) AS BIGINT) AS n FROM l""")
def edge_speeds_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.ewma_with_expiry(table(spark, sf_dir, "edge_obs"), idle_s=86_400).select("gid", F.round("kph", 6).alias("kph"), "n")


@query(f"""{with_('route_edges')}, e AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY ts, event_id) AS place FROM route_edges WHERE length_m > 0), i AS (SELECT *, place - row_number() OVER (PARTITION BY leg, level ORDER BY ts, event_id) AS island FROM e)
SELECT leg, level, CAST(min(place) AS INTEGER) AS first_place, count(*) AS edges, round(sum(length_m), 4) AS length_m, min(kph) AS slowest_kph FROM i GROUP BY leg, level, island""")
def route_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.annotate_runs(table(spark, sf_dir, "route_edges")).select("leg", "level", "first_place", "edges", F.round("length_m", 4).alias("length_m"), "slowest_kph")


@query(f"{with_('route_edges')} SELECT leg, count(*) AS edges, count(CASE WHEN kph > 20 THEN 1 END) AS live, round(count(CASE WHEN kph > 20 THEN 1 END) * 100.0::DOUBLE / count(*), 1) AS pct FROM route_edges GROUP BY leg")
def route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.coverage(table(spark, sf_dir, "route_edges").withColumn("kph", F.when(F.col("kph") > 20, F.col("kph"))))


@query(f"""{with_('route_edges').replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT leg, event_id AS gid, length_m * 10 AS m, NOT coalesce(kph > 20, FALSE) AS bare, row_number() OVER (PARTITION BY leg ORDER BY event_id) AS n FROM route_edges),
r AS (SELECT leg, n, gid, bare, CASE WHEN bare THEN 0 ELSE -1 END AS win, CASE WHEN bare THEN m ELSE 0.0 END AS total FROM e WHERE n = 1
UNION ALL SELECT e.leg, e.n, e.gid, e.bare, CASE WHEN e.bare AND NOT (r.bare AND r.total + e.m <= 2000) THEN r.win + 1 ELSE r.win END, CASE WHEN NOT e.bare THEN 0.0 WHEN r.bare AND r.total + e.m <= 2000 THEN r.total + e.m ELSE e.m END FROM r JOIN e ON e.leg = r.leg AND e.n = r.n + 1)
SELECT leg, gid, win AS "window" FROM r WHERE bare""")
def uncovered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "route_edges").select("leg", F.col("event_id").alias("pos"), F.col("event_id").alias("gid"), (F.col("length_m") * 10).alias("length_m"), F.when(F.col("kph") > 20, F.col("kph")).alias("live_kph"))
    return traffic.uncovered_windows(rows)


@query(f"""{with_('edge_obs', 'points', 'line_ends')}, s AS (SELECT gid, list(kph ORDER BY ts, event_id) AS v FROM edge_obs GROUP BY gid), v AS (SELECT gid, {SMOOTHED} AS kph, CAST(len(v) AS BIGINT) AS n FROM s WHERE len(v) >= 3),
l AS (SELECT p_id, CAST(substr(osm_id, 2) AS BIGINT) AS gid, sqrt(pow(p_lat - a_lat, 2) + pow(p_lon - greatest(least(p_lon, b_lon), a_lon), 2)) AS g FROM points, line_ends WHERE g <= 0.005 QUALIFY row_number() OVER (PARTITION BY p_id ORDER BY g, gid) = 1)
SELECT p_id, gid, kph, n FROM points LEFT JOIN l USING (p_id) LEFT JOIN v USING (gid)""")
def speeds_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible speed of the road nearest to each point."""
    roads = lines(spark, sf_dir).select(F.substring("osm_id", 2, 20).cast("bigint").alias("gid"), "line")
    return traffic.edge_speed_at(table(spark, sf_dir, "points"), roads, traffic.ewma(traffic.plausible(table(spark, sf_dir, "edge_obs")))).select("p_id", "gid", "kph", "n")


@query(f"{with_('edge_obs')}, s AS (SELECT gid, list(kph ORDER BY ts, event_id) AS v FROM edge_obs GROUP BY gid), v AS (SELECT gid, {SMOOTHED} AS kph FROM s WHERE len(v) >= 3)" + """
SELECT event_id, CASE WHEN kph / 60 >= 0.75 THEN 'free' WHEN kph / 60 >= 0.5 THEN 'moderate' WHEN kph / 60 >= 0.25 THEN 'slow' WHEN kph IS NOT NULL THEN 'jam' ELSE 'unknown' END AS level FROM events LEFT JOIN v ON gid = user_id""")
def route_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("gid"), F.lit(60.0).alias("free_flow"))
    return traffic.annotate_route(edges, traffic.ewma(table(spark, sf_dir, "edge_obs"))).select("event_id", "level")


@query("""SELECT (p_partkey * 33554431) & 33554431 AS tile, count(*) AS edges, count(CASE WHEN p_size >= 25 THEN 1 END) AS updated, count(CASE WHEN p_size < 25 THEN 1 END) AS reverted, ((p_partkey * 33554431) & 33554431) % 16 AS shard FROM part GROUP BY 1, 5""")
def tile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") * 33554431).alias("gid"), F.col("p_size").alias("ts"))
    return traffic.tile_rollup(rows, F.lit(25))


@query("""WITH s AS (SELECT event_id, user_id % 20 AS cell, ts, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot FROM events) SELECT cell, slot, event_id FROM s WHERE slot >= (SELECT max(slot) FROM s) - 48 QUALIFY row_number() OVER (PARTITION BY cell, slot ORDER BY ts, event_id) = 1""")
def once_a_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stamped(table(spark, sf_dir, "events")).select("event_id", (F.col("user_id") % 20).alias("cell"), "ts")
    return traffic.once_a_window(rows, 3600, 48).select("cell", "slot", "event_id")


HAV = "2 * 6371000.0 * asin(sqrt(least(1, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))))"


@query(f"""WITH p AS (SELECT user_id AS trace, event_id % 3 AS gid, event_id AS pos, 30 + (event_id * 37 % 1000) / 10000.0::DOUBLE AS lat, 31 + (event_id * 53 % 1000) / 10000.0::DOUBLE AS lon, epoch(ts) AS t FROM events),
l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, t - lag(t) OVER w AS dt FROM p WINDOW w AS (PARTITION BY trace ORDER BY pos)),
s AS (SELECT trace, sum({HAV}) AS m, sum(CASE WHEN dt > 0 THEN dt END) AS s FROM l GROUP BY trace) SELECT trace, gid, round(m / s * 3.6, 5) AS kph FROM (SELECT DISTINCT trace, gid FROM p) JOIN s USING (trace) WHERE s > 0""")
def trace_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stamped(table(spark, sf_dir, "events")).select(F.col("user_id").alias("trace"), (F.col("event_id") % 3).alias("gid"), F.col("event_id").alias("pos"), (30 + (F.col("event_id") * 37 % 1000) / 10000).alias("lat"), (31 + (F.col("event_id") * 53 % 1000) / 10000).alias("lon"), (F.unix_micros("ts") / 1e6).alias("t"))
    return traffic.trace_speed(rows).select("trace", "gid", F.round("kph", 5).alias("kph"))


@query("SELECT user_id AS trace, event_id % 3 AS gid, round(avg(value) * 3.6, 6) AS kph FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def edge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), (F.col("event_id") % 3).alias("gid"), F.col("value").alias("speed"))
    return traffic.edge_means(rows).select("trace", "gid", F.round("kph", 6).alias("kph"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 20")
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.within_budget(table(spark, sf_dir, "events"), 20).select("event_id", F.to_date("ts").alias("day"))


CASES = "c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'named' ELSE 'address' END AS kind, c_custkey AS osm_id, c_name AS name FROM customer), r AS (SELECT o_custkey AS case_id, o_orderkey % 12 + 1 AS rank, o_custkey + o_orderkey % 4 AS osm_id, concat('x', o_orderkey) AS name, CAST(o_orderkey * 7 % 1000 AS DOUBLE) AS distance_m FROM orders)"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 2 == 0, "named").otherwise("address").alias("kind"), F.col("c_custkey").alias("osm_id"), F.col("c_name").alias("name"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), (k % 12 + 1).alias("rank"), (F.col("o_custkey") + k % 4).alias("osm_id"), F.concat(F.lit("x"), k).alias("name"), (k * 7 % 1000).cast("double").alias("distance_m"))


@query(f"""WITH {CASES}, h AS (SELECT c.case_id, c.kind, min(CASE WHEN r.osm_id = c.osm_id THEN rank END) AS strict, min(CASE WHEN r.osm_id = c.osm_id OR lower(r.name) = lower(c.name) OR distance_m <= 150 THEN rank END) AS lenient FROM c LEFT JOIN r USING (case_id) GROUP BY 1, 2)
SELECT kind, count(*) AS cases, """ + ", ".join(f"round(avg(CASE WHEN {c} <= {k} THEN 1.0::DOUBLE ELSE 0 END) * 100, 4) AS {c}_at_{k}" for c in ("strict", "lenient") for k in (1, 5, 10)) + " FROM h GROUP BY kind")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(evaluate.first_hits(cases(spark, sf_dir), results(spark, sf_dir)), ["strict", "lenient"])


@query("""WITH g AS (SELECT event_type AS kind, CAST(user_id % 3 AS VARCHAR) AS source, count(*) AS probes, round(median(value), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1, 2) SELECT *, round(probes / sum(probes) OVER (PARTITION BY kind), 6) AS share FROM g""")
def probe_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("source"), F.col("value").alias("ms")))


@query(f"""WITH {CASES}, a AS (SELECT case_id, list_distinct(list(osm_id)) AS ids FROM r WHERE rank <= 10 GROUP BY 1), b AS (SELECT case_id, list_distinct(list(osm_id)) AS ids FROM r WHERE rank <= 10 AND rank % 2 = 0 GROUP BY 1)
SELECT case_id, round(coalesce(len(list_intersect(a.ids, b.ids)), 0) / len(a.ids), 6) AS overlap FROM a LEFT JOIN b USING (case_id)""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return evaluate.overlap(r.where("rank % 2 = 0"), r)


@query("""WITH r AS (SELECT CAST(user_id % 4 AS VARCHAR) AS city, user_id AS probe, event_type FROM events), e AS (SELECT city, probe, count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) / count(*) AS share, count(CASE WHEN event_type = 'error' THEN 1 END) AS bad FROM r GROUP BY 1, 2)
SELECT city, round(avg(share), 6) AS hit_rate, CAST(sum(bad) AS BIGINT) AS forbidden_hits FROM e GROUP BY ROLLUP (city)""")
def category_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("string").alias("city"), F.col("user_id").alias("probe"), F.col("event_type").alias("category_value"))
    probes = rows.select("probe").distinct()
    wanted = probes.select("probe", F.explode(F.array(F.lit("view"), F.lit("click"))).alias("category_value"))
    return evaluate.category_hits(rows, wanted, probes.withColumn("category_value", F.lit("error")))


@query("""SELECT count(CASE WHEN event_type = 'view' THEN 1 END) AS ok, count(CASE WHEN event_type = 'error' THEN 1 END) AS fail, round(count(CASE WHEN event_type = 'view' THEN 1 END) / nullif(count(CASE WHEN event_type IN ('view', 'error') THEN 1 END), 0), 6) AS rate FROM events""")
def interpolation_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "fail").otherwise("na")
    return evaluate.probe_rate(table(spark, sf_dir, "events").select(outcome.alias("outcome")))


@query(f"{with_('names')}, b AS (SELECT * FROM names WHERE trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY offline_rank DESC, osm_id) = 1) SELECT osm_id, name FROM b ORDER BY offline_rank DESC, osm_id LIMIT 200")
def named_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.named_cases(table(spark, sf_dir, "names"), 200).select("osm_id", "name")


def _streamed(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """All results of a stream over what is there now, by way of the shared folder; of keys (update mode) each one's last."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{run}/out")
    if keys is None:
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("last"))
    return last.select(*keys, "last.*")


@query(ROLLUP + " SELECT tenant, key_id, period, day, endpoint, milli, requests FROM r")
def usage_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    n = F.col("event_type")
    rows = stream.select(F.concat(F.lit("t"), F.col("user_id") % 10).alias("tenant"), F.concat(F.lit("k"), F.col("user_id")).alias("key_id"),
        F.when(n == "view", "geocode").when(n == "click", "reverse").when(n == "signup", "matrix").when(n == "purchase", "nearby").otherwise("autocomplete").alias("endpoint"),
        F.when(n == "signup", 5000).when(n == "error", 250).otherwise(1000).cast("bigint").alias("milli"), F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, jobs.rollup_stream(rows), "update", ["tenant", "key_id", "period", "day", "endpoint"]).select("tenant", "key_id", "period", "day", "endpoint", "milli", "requests")
