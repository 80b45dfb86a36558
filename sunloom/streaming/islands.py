"""Contiguous periods of a stream of times: session windows with the resolution as their gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contiguous_periods(stream: DataFrame, resolution: int, min_length: int, keys: Sequence[str] = (), ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(keys, start_dt, end_dt) of islands with more than min_length distinct times, closed once the watermark passes.

    Works on a stream (append mode) and on a table, with the result of the batch operator.
    """
    times = stream.withColumn("_at", F.col(ts).cast("timestamp"))
    times = times.withWatermark("_at", late) if stream.isStreaming else times
    # A repeated time counts once; what the watermark has passed is forgotten, so a session keeps three numbers only.
    times = times.dropDuplicates([*keys, "_at"])
    sessions = times.groupBy(*keys, F.session_window("_at", f"{resolution} minutes").alias("_w")).agg(F.min("_at").alias("start_dt"), F.max("_at").alias("end_dt"), F.count("*").alias("_n"))
    return sessions.where(F.col("_n") > min_length).select(*keys, F.col("start_dt").cast("timestamp_ntz").alias("start_dt"), F.col("end_dt").cast("timestamp_ntz").alias("end_dt"))
