"""Structured Streaming: imports that take an event once, window joins, counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def read_events(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Files of a folder as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(folder)


def first_of_key(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within ``delay``; state for older keys is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_join(trades: DataFrame, events: DataFrame, keys: list[str], days: int, delay: str = "1 day", trade_time: str = "traded_at", event_time: str = "happened_at") -> DataFrame:
    """Stream-stream join of trades with events of equal keys within ``days``; watermarks bound both states."""
    t = trades.withWatermark(trade_time, delay)
    e = events.select(*[F.col(k).alias(f"e_{k}") for k in keys], *[c for c in events.columns if c not in keys]).withWatermark(event_time, delay)
    near = F.expr(f"{trade_time} BETWEEN {event_time} - INTERVAL {days} DAYS AND {event_time} + INTERVAL {days} DAYS")
    for k in keys:
        near = near & (F.col(k) == F.col(f"e_{k}"))
    return t.join(e, near).drop(*[f"e_{k}" for k in keys])


def counts_by_window(events: DataFrame, kind: str, time: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, delay).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), kind, "n")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there, written to the shared folder and read back; a restart from the checkpoint repeats nothing."""
    spark = stream.sparkSession
    out, check = scratch(spark, "stream"), scratch(spark, "stream-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start(out)
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
