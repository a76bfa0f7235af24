"""Event streams: windowed counts with a watermark and a stateful rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files with zoned times (watermarks need them)."""
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type; late events within the watermark still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def rate_limited(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """(user_id, event_id, allowed): a window opens at a user's first event and at the first one after its end.

    State is one (end, count) pair a user. Within a batch a user's events are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        until, count = state.get if state.exists else (0.0, 0)
        allowed = []
        for t in rows["ts"]:
            at = t.timestamp()
            if not count or at > until:
                until, count = at + seconds, 0
            count += 1
            allowed.append(count <= most)
        state.update((until, count))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, allowed boolean", "until double, count long", "append", GroupStateTimeout.NoTimeout
    )
