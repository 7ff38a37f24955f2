"""Structured Streaming forms of the engine's time-based operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files; timestamps are given the session's time zone, as watermarks need it."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def request_rate(events: DataFrame, window: str = "60 seconds", limit: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests of each user in tumbling windows, and whether they pass the limit; state is let go after the watermark."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("requests"))
    return counted.select("user_id", F.col("window.start").alias("start"), "requests", (F.col("requests") > limit).alias("over"))


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark: a cache miss; later ones would be hits."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def quarantine(events: DataFrame, path: str, checkpoint: str, most: int = 3):
    """Write keys with ``most`` or more failures to a dead-letter table, batch by batch, from running counts."""
    failed = events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.where(F.col("failures") >= most).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return failed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)


def cache_with_ttl(events: DataFrame, key: str, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Each event as a hit or miss of a keyed cache whose entries live ``ttl_seconds`` after they were stored.

    A key's state is the time its entry was stored; a lookup after the entry has run out stores it anew. Entries whose time is over by the
    watermark are let go, so state is bounded by the keys of one lifetime.
    """
    schema = events.select(key, "ts").schema
    kind = schema[key].dataType.simpleString()

    def look_up(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        stored = state.get[0] if state.exists else None
        hits = []
        for at in rows["ts"].astype("datetime64[us]").astype("int64"):
            hits.append(stored is not None and 0 <= at - stored < ttl_seconds * 1_000_000)
            if not hits[-1]:
                stored = int(at)
        state.update((stored,))
        end = stored // 1_000 + ttl_seconds * 1_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(rows), "ts": rows["ts"].to_numpy(), "hit": hits})

    watched = events.select(key, "ts").withWatermark("ts", late)
    return watched.groupBy(key).applyInPandasWithState(look_up, f"{key} {kind}, ts timestamp, hit boolean", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def new_files(spark: SparkSession, folder: str, suffix: str = "pdf", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the files that arrive in a folder: path, length, modification time and content."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(folder)
