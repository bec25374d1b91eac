"""Queries of the streaming monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..streaming import monitor
from .data_queries import rounded
from .registry import query

_REF = "r AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)"
_WIN = "w AS (SELECT date_trunc('day', ts) AS t, event_type, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1, 2)"
_ROW = "strftime(t, '%Y-%m-%d') AS day, event_type, n, round(mean, 6) AS mean, round((mean - m) / s, 6) + 0.0 AS shift"


@query("drift_windows", f"WITH {_REF}, {_WIN} SELECT {_ROW} FROM w JOIN r USING (event_type)")
def drift_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The monitor on the table as a batch."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = monitor.drift_windows(events, monitor.reference_statistics(events))
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean", "shift"))


@query("stream_drift_monitor", f"WITH {_REF}, {_WIN}, z AS (SELECT max(ts) - INTERVAL 1 HOUR AS z FROM events) SELECT {_ROW} FROM w JOIN r USING (event_type), z WHERE t + INTERVAL 1 DAY <= z")
def stream_drift_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """The monitor on the table's files as a stream: the windows that the watermark has closed."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = monitor.replay(events, sf, "events.parquet", f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}")
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean", "shift"))
