"""API usage from access logs to rollups, quotas and invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.operators.folds import ordered_fold

#: Paths that cost nothing, thousandths of a credit for a call.
FREE_PATHS = ["/health", "/metrics", "/docs", "/openapi.json", "/nearby/categories"]
DEFAULT_MILLI = 1000


def url_path(uri: Column) -> Column:
    """The path of a URL or URI without query and closing slash; '/' for none."""
    path = F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def endpoint(uri: Column) -> Column:
    """First segment of the path."""
    return F.regexp_extract(url_path(uri), "^/?([^/]*)", 1)


def period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def key_of_consumer(consumer: Column) -> Column:
    """What stands after the last '-key-'."""
    return F.nullif(F.regexp_extract(consumer, "-key-([^-]+)$", 1), F.lit(""))


def is_free(uri: Column, free: list[str] = FREE_PATHS) -> Column:
    return url_path(uri).isin(free)


def served(log: DataFrame, free: list[str] = FREE_PATHS) -> DataFrame:
    """Log rows with a consumer, a status under 400 and a path that costs something."""
    return log.where(F.col("consumer").isNotNull() & (F.col("status") < 400) & ~is_free(F.col("uri"), free))


def matrix_milli(uri: Column, rate_milli: int = 100, floor_milli: int = 5000) -> Column:
    """Weight of a matrix request: cells times rate, at least the floor; sizes from the JSON in its query."""
    body = F.from_json(F.url_decode(F.regexp_extract(uri, "[?&]json=([^&]*)", 1)), "sources array<string>, targets array<string>")
    cells = F.greatest(F.coalesce(F.size(body["sources"]), F.lit(0)), F.lit(0)) * F.greatest(F.coalesce(F.size(body["targets"]), F.lit(0)), F.lit(0))
    return F.greatest(F.lit(floor_milli), cells * rate_milli).cast("bigint")


def weighted(log: DataFrame, weights: DataFrame, default: int = DEFAULT_MILLI) -> DataFrame:
    """Served rows with endpoint, key and weight in thousandths; weights (endpoint, weight_milli) is a small table."""
    rows = log.withColumn("endpoint", endpoint(F.col("uri"))).withColumn("key_id", key_of_consumer(F.col("consumer")))
    rows = rows.join(weights, "endpoint", "left")
    return rows.withColumn("milli", F.when(F.col("endpoint") == "matrix", matrix_milli(F.col("uri"))).otherwise(F.coalesce("weight_milli", F.lit(default))).cast("bigint")).drop("weight_milli")


def rollup(events: DataFrame) -> DataFrame:
    """Thousandths and requests by tenant, key, period, day and endpoint; events without weight count DEFAULT_MILLI."""
    day = F.to_date("ts")
    return events.groupBy("tenant", "key_id", period(F.col("ts")).alias("period"), day.alias("day"), "endpoint").agg(F.sum(F.coalesce("milli", F.lit(DEFAULT_MILLI))).alias("milli"), F.count("*").alias("requests"))


def added(rollups: DataFrame, more: DataFrame) -> DataFrame:
    """Two rollups as one: their sums by key."""
    keys = ["tenant", "key_id", "period", "day", "endpoint"]
    return rollups.unionByName(more).groupBy(*keys).agg(F.sum("milli").alias("milli"), F.sum("requests").alias("requests"))


def tenant_totals(rollups: DataFrame, tenants: DataFrame, of_period: str) -> DataFrame:
    """Every tenant's thousandths and requests of a period, 0 without usage."""
    used = rollups.where(F.col("period") == of_period).groupBy("tenant").agg(F.sum("milli").alias("milli"), F.sum("requests").alias("requests"))
    return tenants.select("tenant").join(used, "tenant", "left").select("tenant", F.coalesce("milli", F.lit(0)).alias("milli"), F.coalesce("requests", F.lit(0)).alias("requests"))


def key_usage(rollups: DataFrame, keys: DataFrame, of_period: str) -> DataFrame:
    """Every key's usage of a period, 0 without."""
    used = rollups.where(F.col("period") == of_period).groupBy("key_id").agg(F.sum("milli").alias("milli"), F.sum("requests").alias("requests"))
    return keys.join(used, "key_id", "left").na.fill(0, ["milli", "requests"])


def history(rollups: DataFrame, first: str, last: str) -> DataFrame:
    """Usage by period, day and endpoint between two periods."""
    return rollups.where(F.col("period").between(first, last)).groupBy("period", "day", "endpoint").agg(F.sum("milli").alias("milli"), F.sum("requests").alias("requests"))


def charge_cents(milli: Column, base: Column, quota: Column, rate: Column) -> Column:
    """base plus every credit beyond the quota at the rate, rounded up to a cent; computed in doubles."""
    over = F.greatest(milli / 1000.0 - quota, F.lit(0.0))
    return base + F.ceil(over * rate.cast("double")).cast("bigint")


def invoices(totals: DataFrame, tenants: DataFrame, plans: DataFrame) -> DataFrame:
    """An invoice for each tenant on a plan (plan, base_cents, quota, overage_cents): total and line items."""
    rows = totals.join(tenants.select("tenant", "plan"), "tenant").join(plans, "plan")
    total = charge_cents(F.col("milli"), F.col("base_cents"), F.col("quota"), F.col("overage_cents"))
    over = F.greatest(F.col("milli") / 1000.0 - F.col("quota"), F.lit(0.0))
    items = F.array(F.struct(F.lit("base").alias("item"), F.lit(1.0).alias("quantity"), F.col("base_cents").cast("bigint").alias("cents")), F.struct(F.lit("overage").alias("item"), over.alias("quantity"), (total - F.col("base_cents")).cast("bigint").alias("cents")))
    return rows.select("tenant", "plan", "milli", "requests", total.cast("bigint").alias("total_cents"), items.alias("line_items"))


def upsert_invoices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Invoices by tenant and period: a new one replaces the old only while that is pending."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, ["tenant", "period"], "full_outer")
    keep = F.col("o.status").isNotNull() & (F.col("o.status") != "pending")
    rest = [c for c in old.columns if c not in ("tenant", "period")]
    return joined.select("tenant", "period", *[F.when(keep | F.col("n.status").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in rest])


def bursts(events: DataFrame, most: int) -> DataFrame:
    """Requests of each tenant and second, and whether they are too many."""
    counts = events.groupBy("tenant", F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("requests"))
    return counts.withColumn("over_limit", F.col("requests") > most)


def quota_replay(events: DataFrame, quota_milli: int) -> DataFrame:
    """Each event with accepted: a running sum of tenant and period where a rejected event uses nothing up.

    The order decides, so each tenant and period is one ordered pass with the sum as its state.
    """

    def step(used: int, event_id: int, milli: int | None) -> tuple[int, tuple]:
        ok = milli is not None and used + milli <= quota_milli
        used = max(0, used + milli) if ok else used  # a refund is a negative use
        return used, (event_id, ok, used)

    rows = events.withColumn("period", period(F.col("ts"))).withColumn("milli", F.col("milli").cast("bigint")).withColumn("event_id", F.col("event_id").cast("bigint"))
    return ordered_fold(rows, ["tenant", "period"], ["ts", "event_id"], ["event_id", "milli"], "event_id bigint, accepted boolean, used bigint", int, step)


def plan_counts(tenants: DataFrame) -> DataFrame:
    """Tenants by plan that aren't deleted."""
    return tenants.where(F.col("status") != "deleted").groupBy("plan").agg(F.count("*").alias("tenants"))


def joined_keys(events: DataFrame, keys: DataFrame, tenants: DataFrame, plans: DataFrame, weights: DataFrame) -> DataFrame:
    """Events with their key's tenant, its plan and the endpoint's weight (DEFAULT_MILLI without)."""
    rows = events.join(keys, "key_id").join(tenants, "tenant").join(plans, "plan").join(weights, "endpoint", "left")
    return rows.withColumn("weight_milli", F.coalesce("weight_milli", F.lit(DEFAULT_MILLI)))


