"""Streaming counterparts of the time-driven behaviours, over any stream of events (event_id, ts, user_id, event_type, value).

Each builder takes a streaming (or plain) DataFrame and returns one; `run_once` drives a
streaming one to the end of what is there and hands back its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming import stateful

LATE = "7 days"


def source(spark: SparkSession, path: str, name: str = "events") -> DataFrame:
    """Parquet files as they arrive; the schema comes from what is there."""
    table = spark.read.parquet(f"{path}/{name}.parquet")
    reader = spark.readStream.schema(table.schema)
    single = any(f.endswith(f"/{name}.parquet") for f in table.inputFiles())  # a stream reads folders: of a lone file, the one it is in
    rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(path) if single else reader.parquet(f"{path}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def write_rate(events: DataFrame) -> DataFrame:
    """Writes of each scope in sliding minutes, a new one every 10 seconds."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "60 seconds", "10 seconds"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def rate_limiter(events: DataFrame, most: int = 50, seconds: float = 60.0) -> DataFrame:
    """R1, W7 exactly: (user_id, event_id, accepted): only accepted writes count; late ones are refused."""
    return stateful.limited(events, F.col("user_id"), most, seconds, LATE).withColumnRenamed("key", "user_id")


def access_reinforcement(events: DataFrame, memories: int = 100, seconds: float = 300.0) -> DataFrame:
    """R2: (id, event_id, counted): an access counts if the last one that counted lies `seconds` or more before; one that does not count does not put the next off."""
    return stateful.limited(events, F.col("event_id") % memories, 1, seconds, LATE).select(F.col("key").alias("id"), "event_id", F.col("accepted").alias("counted"))


def access_flush(events: DataFrame, memories: int = 100, cooldown: float = 300.0, flush: float = 5.0) -> DataFrame:
    """R2: (id, accesses, flushed_us): what counts of each memory's accesses, in batches of `flush` seconds."""
    return stateful.flushed_accesses(events, F.col("event_id") % memories, cooldown, flush).withColumnRenamed("key", "id")


def hit_counters(events: DataFrame) -> DataFrame:
    """Hits and last hit of each memory, kept up to date."""
    return events.groupBy((F.col("event_id") % 100).alias("id")).agg(F.count("*").alias("hits"), F.max("ts").alias("last_hit"))


def once_per_session(events: DataFrame) -> DataFrame:
    """What a session has been shown is not shown again while the watermark remembers it."""
    return events.withWatermark("ts", LATE).withColumn("session", F.col("user_id") % 50).dropDuplicatesWithinWatermark(["session", "event_type"]).select("session", "event_type")


def heartbeats(events: DataFrame) -> DataFrame:
    """The last event of each source; staleness is a filter over it."""
    return events.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last"))


def health_windows(events: DataFrame) -> DataFrame:
    """Successes and failures in sliding weeks."""
    w = F.window("ts", "7 days", "1 day")
    return events.withWatermark("ts", LATE).groupBy(w).agg(F.count("*").alias("total"), F.sum((F.col("event_type") == "error").cast("int")).alias("failures")).select(F.col("window.start").alias("start"), "total", "failures")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events without a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", LATE).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def scopes_due(events: DataFrame, scope: str = "user_id", least: int = 10) -> DataFrame:
    """(scope, writes) of the scopes whose writes since the last run have reached a threshold, kept up to date."""
    return events.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("writes")).where(F.col("writes") >= least)


def on_threshold(events: DataFrame, least: int, act: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A sink that acts on the scopes whose writes in a batch reach a threshold."""

    def f(batch: DataFrame, _: int) -> None:
        act(batch.groupBy("user_id").agg(F.count("*").alias("writes")).where(F.col("writes") >= least))

    return f


def run_once(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that is there and return its rows, which the executors write below `folder`; none passes through the driver.

    The state store is one that keeps typed states; the session's setting comes back afterwards.
    A batch that is run again overwrites its own folder.  In complete mode the last batch has all rows, in append mode each has its own.
    """
    if not df.isStreaming:
        return df
    where, written = f"{folder.rstrip('/')}/{uuid.uuid4().hex}", {}

    def write(batch: DataFrame, n: int) -> None:
        written[n] = f"{where}/rows/{n}"
        batch.write.mode("overwrite").parquet(written[n])

    conf = df.sparkSession.conf
    before = conf.get(stateful.STATE_STORE[0])
    conf.set(*stateful.STATE_STORE)
    try:
        df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(stateful.STATE_STORE[0], before)
    if not written:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(*([written[max(written)]] if mode == "complete" else written.values()))
