"""Counters, latencies and request lifecycles over a stream of events.

Every query here is a plain DataFrame aggregation that also runs on a static table, so batch and stream
share their definition. Windows use event time; state is dropped once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = "10 minutes"


def stream_counters(events: DataFrame, width: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Events per window and type."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_latency(events: DataFrame, width: str = "1 hour", delay: str = DELAY, stage: str = "event_type", value: str = "value") -> DataFrame:
    """Latency statistics per window and stage."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), stage).agg(
        F.count(value).alias("count"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), F.avg(value).alias("avg_ms")
    )


def stream_rate_breach(
    events: DataFrame, limit: int = 120, width: str = "1 minute", client: str = "user_id", delay: str = DELAY
) -> DataFrame:
    """Clients with more than ``limit`` calls in one window."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width), client).agg(F.count(F.lit(1)).alias("calls"))
    return counted.where(F.col("calls") > limit)


def lifecycle_columns(value: str = "value") -> list[Column]:
    """What the events of one request say about it."""
    event = F.col("event")
    return [
        F.count(F.lit(1)).alias("events"), F.count_if(event.isin("stage_failed", "request_failed")).alias("failures"),
        F.min(F.when(event == "llm_first_token", F.col(value))).alias("first_token"),
        F.max(event == "request_completed").alias("completed"),
    ]


def stream_lifecycle(events: DataFrame, gap: str = "5 minutes", delay: str = DELAY, key: str = "request_id") -> DataFrame:
    """One row per request once no event of it came for ``gap``; later stages are late and dropped."""
    return events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap)).agg(*lifecycle_columns())


def stream_dedup(requests: DataFrame, key: str = "request_id", delay: str = DELAY) -> DataFrame:
    """First row of every request id that comes again within the watermark."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
