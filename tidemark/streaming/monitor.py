"""A drift monitor on a stream of events: windowed statistics by type against a reference table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_statistics(events: DataFrame) -> DataFrame:
    """event_type, ref_mean, ref_sd of a batch of past events (one row for each type)."""
    return events.groupBy("event_type").agg(F.avg("value").alias("ref_mean"), F.stddev_pop("value").alias("ref_sd"))


def drift_windows(events: DataFrame, reference: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, mean, shift: the windows' means in standard deviations of the reference.

    events may be a stream (a window is emitted when the watermark passes its end) or a table. State is
    one row for each open window and type. Events without a time or type are left out.
    """
    named = events.where("ts is not null and event_type is not null")
    timed = named.withWatermark("ts", late) if named.isStreaming else named
    each = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    shift = (F.col("mean") - F.col("ref_mean")) / F.nullif("ref_sd", F.lit(0.0))
    return each.join(F.broadcast(reference), "event_type", "left").select(F.col("window.start").alias("window_start"), "event_type", "n", "mean", shift.alias("shift"))


def run_available(stream: DataFrame, out: str, checkpoint: str | None = None) -> None:
    """Write all that the stream has now to Parquet under out and stop; a restart goes on from the checkpoint."""
    at = checkpoint or f"{out}-checkpoint-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def replay(events: DataFrame, folder: str, files: str, out: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Run the monitor over the files in folder that match as a stream, with the whole of events as reference; the closed windows."""
    spark = events.sparkSession
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", files).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    run_available(drift_windows(stream, reference_statistics(events), window, late), out)
    return spark.read.parquet(out)
