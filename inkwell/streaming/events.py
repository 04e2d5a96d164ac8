"""Streaming faces: the call log as a stream, windowed event counts, and the last best value of a key as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
CALL = "chapter_id STRING, attempt INT, request STRING, response STRING, at TIMESTAMP"


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Appended JSON lines of model calls as a stream."""
    return spark.readStream.schema(CALL).json(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and tumbling window; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def best_by_key(events: DataFrame) -> DataFrame:
    """For a stream: each user's event of the highest value so far, the later of equals, kept as state."""
    import pandas as pd

    def update(key, batches, state):
        best = state.get if state.exists else None
        for batch in batches:
            for value, event in zip(batch["value"], batch["event_id"]):
                if value == value and (best is None or (value, event) >= tuple(best)):
                    best = (float(value), int(event))
        if best is not None:
            state.update(tuple(best))
            yield pd.DataFrame({"user_id": [key[0]], "value": [best[0]], "event_id": [best[1]]})

    return events.select("user_id", "value", "event_id").groupBy("user_id").applyInPandasWithState(update, "user_id BIGINT, value DOUBLE, event_id BIGINT", "value DOUBLE, event_id BIGINT", "update", "NoTimeout")
