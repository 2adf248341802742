"""Retrieval quality from ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_hits(cases: DataFrame, results: DataFrame, lenient_m: float = 150.0) -> DataFrame:
    """Each case with the rank of its own id (strict) and of the first result with its name or within lenient_m (lenient)."""
    joined = cases.join(results.select("case_id", "rank", F.col("osm_id").alias("got"), F.lower("name").alias("got_name"), "distance_m"), "case_id", "left")
    near = (F.col("got") == F.col("osm_id")) | (F.col("got_name") == F.lower("name")) | (F.col("distance_m") <= lenient_m)
    return joined.groupBy("case_id", "kind").agg(F.min(F.when(F.col("got") == F.col("osm_id"), F.col("rank"))).alias("strict"), F.min(F.when(near, F.col("rank"))).alias("lenient"))


def recall(hits: DataFrame, ranks: list[str], at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of all cases of each kind whose rank is within k, in per cent."""
    share = lambda c, k: F.round(F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0)) * 100, 4).alias(f"{c}_at_{k}")
    return hits.groupBy("kind").agg(F.count("*").alias("cases"), *[share(c, k) for c in ranks for k in at])


def latency(probes: DataFrame) -> DataFrame:
    """Probes, share, median and 90th percentile of milliseconds by kind and source."""
    rows = probes.groupBy("kind", "source").agg(F.count("*").alias("probes"), F.round(F.median("ms"), 6).alias("p50"), F.round(F.expr("percentile(ms, 0.9)"), 6).alias("p90"))
    return rows.withColumn("share", F.round(F.col("probes") / F.sum("probes").over(Window.partitionBy("kind")), 6))


def category_hits(results: DataFrame, wanted: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """For each city, and for all (city null): mean share of a probe's results in its wanted categories; forbidden results."""
    flagged = results.join(wanted.withColumn("wanted", F.lit(1)), ["probe", "category_value"], "left")
    if forbidden is not None:
        flagged = flagged.join(forbidden.withColumn("bad", F.lit(1)), ["probe", "category_value"], "left")
    bad = F.count("bad") if forbidden is not None else F.lit(0)
    each = flagged.groupBy("city", "probe").agg((F.count("wanted") / F.count("*")).alias("share"), bad.alias("bad"))
    return each.rollup("city").agg(F.round(F.avg("share"), 6).alias("hit_rate"), F.sum("bad").cast("bigint").alias("forbidden_hits"))


def overlap(results: DataFrame, baseline: DataFrame, k: int = 10) -> DataFrame:
    """Each case's share of the baseline's first k ids among its own first k."""
    ids = lambda df, name: df.where(F.col("rank") <= k).groupBy("case_id").agg(F.collect_set("osm_id").alias(name))
    both = ids(baseline, "a").join(ids(results, "b"), "case_id", "left")
    return both.select("case_id", F.round(F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)) / F.size("a"), 6).alias("overlap"))


def probe_rate(probes: DataFrame) -> DataFrame:
    """Interpolation probes that came out right, those that can't be judged aside."""
    return probes.agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "fail").alias("fail"), F.round(F.count_if(F.col("outcome") == "ok") / F.nullif(F.count_if(F.col("outcome").isin("ok", "fail")), F.lit(0)), 6).alias("rate"))


def named_cases(places: DataFrame, n: int) -> DataFrame:
    """Test cases: the n names of highest rank, one place for each name in any case."""
    best = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.desc("offline_rank"), "osm_id"))
    rows = places.where(F.trim("name") != "").withColumn("place", best).where("place = 1").drop("place")
    return rows.orderBy(F.desc("offline_rank"), "osm_id").limit(n)


def address_cases(addresses: DataFrame, n: int) -> DataFrame:
    """Test cases: one address for each number, street and city, n of them."""
    key = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in ("number", "street_norm", "city")]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("osm_id"))
    return addresses.withColumn("place", first).where("place = 1").drop("place").orderBy("osm_id").limit(n)


def confidence(score: Column, by: str) -> Column:
    """A score's share of its query's best, up to 1."""
    best = F.max(score).over(Window.partitionBy(by))
    return F.when(best > 0, F.round(F.least(score / best, F.lit(1.0)), 4)).otherwise(0.0)
