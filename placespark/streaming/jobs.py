"""Streaming twins of the batch jobs: the same functions over micro-batches, with checkpoints and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from placespark.operators.metering import DEFAULT_MILLI, period
from placespark.operators.traffic import ALPHA, IDLE_S, two_decimals
from placespark.sources.elements import ELEMENT


def element_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New element files of a folder; the checkpoint knows those already taken, and marks them only after success."""
    return spark.readStream.schema(ELEMENT).option("maxFilesPerTrigger", files_a_batch).json(folder)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions that are whole, ascending."""
    files, at = _file_system(spark, table)
    folder = at(f"{table}/_versions")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _buckets_of(spark: SparkSession, table: str, number: int) -> dict[int, int]:
    """Where a version's buckets are: bucket -> the version that wrote it."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version bigint").json(f"{table}/_versions/{number}").collect()}


def upsert_stream(stream: DataFrame, table: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, keep: int = 2, key: str = "osm_id", buckets: int = 64) -> StreamingQuery:
    """Merge every micro-batch into a Parquet table of key buckets: a batch reads and writes only the buckets that it has keys of.

    merge gets the old rows of these buckets (none at first) and the batch. A version is a list of buckets and of the versions that wrote
    them: it is written aside and renamed, and never changed, so that readers find a whole version at any time. A batch that runs again
    starts from the version before it and writes the same, so nothing is counted twice. What the last `keep` versions (2 at
    least) don't name is removed.
    """
    spark, keep = stream.sparkSession, max(2, keep)

    def apply(batch: DataFrame, number: int) -> None:
        files, at = _file_system(spark, table)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        before = max((v for v in _manifests(spark, table) if v < number), default=None)
        held = {} if before is None else _buckets_of(spark, table, before)
        batch = batch.persist()
        try:
            touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
            paths = [f"{table}/v={held[b]}/bucket={b}" for b in touched if b in held]
            old = spark.read.parquet(*paths) if paths else None
            merged = merge(old, batch)
            merged.select("*", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/v={number}")
        finally:
            batch.unpersist()
        rows = [(b, number if b in touched else held[b]) for b in sorted({*held, *touched})]
        aside = f"{table}/_versions/_{number}"
        spark.createDataFrame(rows, "bucket int, version bigint").coalesce(1).write.mode("overwrite").json(aside)
        files.delete(at(f"{table}/_versions/{number}"), True)
        if not files.rename(at(aside), at(f"{table}/_versions/{number}")):
            raise OSError(f"version {number} of {table} couldn't be named")
        _clear(spark, table, keep)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _clear(spark: SparkSession, table: str, keep: int) -> None:
    """Remove versions before the last `keep`, and the buckets that only they name."""
    files, at = _file_system(spark, table)
    numbers = _manifests(spark, table)
    needed = {(b, v) for n in numbers[-keep:] for b, v in _buckets_of(spark, table, n).items()}
    for n in numbers[:-keep]:
        for b, v in _buckets_of(spark, table, n).items():
            if (b, v) not in needed:
                files.delete(at(f"{table}/v={v}/bucket={b}"), True)
        files.delete(at(f"{table}/_versions/{n}"), True)


def latest_version(spark: SparkSession, table: str, number: int) -> DataFrame:
    """A version's rows."""
    return spark.read.parquet(*[f"{table}/v={v}/bucket={b}" for b, v in _buckets_of(spark, table, number).items()])


def current_version(spark: SparkSession, table: str) -> DataFrame:
    """The last whole version."""
    return latest_version(spark, table, _manifests(spark, table)[-1])


def rollup_stream(events: DataFrame) -> DataFrame:
    """Running rollups by tenant, key, period, day and endpoint (update mode)."""
    return events.groupBy("tenant", "key_id", period(F.col("ts")).alias("period"), F.to_date("ts").alias("day"), "endpoint").agg(F.sum(F.coalesce("milli", F.lit(DEFAULT_MILLI))).alias("milli"), F.count("*").alias("requests"))


def burst_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests of each tenant and second."""
    return events.withWatermark("ts", late).groupBy("tenant", F.window("ts", "1 second")).agg(F.count("*").alias("requests")).select("tenant", F.col("window.start").alias("second"), "requests")


def once_a_window_stream(observations: DataFrame, interval: str, late: str) -> DataFrame:
    """One observation of each cell and interval; those later than `late` are dropped."""
    slot = F.window("ts", interval)["start"].alias("slot")
    return observations.withWatermark("ts", late).withColumn("slot", slot).dropDuplicatesWithinWatermark(["cell", "slot"])


class EdgeSpeed(StatefulProcessor):
    """Smoothed speed of an edge, kept with two decimals as in the batch job, started anew after `idle` seconds without observations.

    With expires, a timer of event time reverts an edge that has been idle: it is reported once with no speed, and forgotten.
    """

    def __init__(self, alpha: float = ALPHA, idle: int = IDLE_S, expires: bool = False):
        self.alpha, self.idle, self.expires = alpha, idle, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("speed", "kph double, n bigint, ts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        kph, n, last = self.state.get() if self.state.exists() else (0.0, 0, 0.0)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for row in batch.itertuples():
            ts = pd.Timestamp(row.ts).timestamp()
            fresh = n == 0 or ts - last > self.idle
            weight = self.alpha * float(getattr(row, "weight", 1.0))
            kph = two_decimals(row.kph if fresh else (1 - weight) * kph + weight * row.kph)
            n, last = (1 if fresh else n + 1), max(ts, last)
        self.state.update((kph, n, last))
        if self.expires:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((last + self.idle) * 1000))
        yield pd.DataFrame({"gid": [key[0]], "kph": [kph], "n": [n], "ts": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.state.get()[2] if self.state.exists() else None
        self.state.clear()
        yield pd.DataFrame({"gid": [key[0]], "kph": pd.Series([None], dtype="float64"), "n": [0], "ts": [last]})

    def close(self) -> None:
        pass


def speed_stream(observations: DataFrame, alpha: float = ALPHA, idle: int = IDLE_S, late: str | None = None) -> DataFrame:
    """(gid, kph, n, ts) after each micro-batch with observations (gid, kph, ts, event_id) of the edge; needs the RocksDB
    state store. With late (how late observations can come), idle edges are reported without speed (n 0) and forgotten."""
    timed = observations if late is None else observations.withWatermark("ts", late)
    return timed.groupBy("gid").transformWithStateInPandas(EdgeSpeed(alpha, idle, late is not None), "gid bigint, kph double, n bigint, ts double", "Update", "None" if late is None else "EventTime")


class Quota(StatefulProcessor):
    """Running use of a tenant and period: what doesn't fit is rejected and uses nothing; refunds give back, never below nothing."""

    def __init__(self, quota_milli: int):
        self.quota = quota_milli

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("used", "milli bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        used = self.state.get()[0] if self.state.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        accepted = []
        for milli in batch["milli"].tolist():
            ok = used + milli <= self.quota
            used = max(0, used + milli) if ok else used  # a refund is a negative use
            accepted.append(ok)
        self.state.update((used,))
        yield pd.DataFrame({"tenant": key[0], "period": key[1], "event_id": batch["event_id"].tolist(), "accepted": accepted})

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, quota_milli: int) -> DataFrame:
    rows = events.withColumn("period", period(F.col("ts")))
    return rows.groupBy("tenant", "period").transformWithStateInPandas(Quota(quota_milli), "tenant string, period string, event_id bigint, accepted boolean", "Append", "None")


def with_refunds(events: DataFrame) -> DataFrame:
    """Usage events (ok: whether the call was served) with a refund for each that failed, right after it and of its own id."""
    failed = events.where(~F.col("ok")).withColumn("milli", -F.col("milli")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")).withColumn("event_id", -F.col("event_id"))
    return events.unionByName(failed).drop("ok")


def popularity_stream(feedback: DataFrame) -> DataFrame:
    """Running sums of boosts of each place (update mode)."""
    return feedback.groupBy("osm_id").agg(F.sum(F.least(F.greatest("boost", F.lit(0.1)), F.lit(10.0))).alias("boosts"))


def rebuild_when_due(last_ts: float, now_ts: float, every_s: float, build: Callable[[], DataFrame]) -> DataFrame | None:
    """A scheduled rebuild, such as of the prefix index: only when every_s have passed."""
    return build() if now_ts - last_ts >= every_s else None
