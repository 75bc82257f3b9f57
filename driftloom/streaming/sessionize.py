"""Events as a stream: sessions by a gap in time, and a cache that takes each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """user_id, start, end and number of events of stretches without a gap; for streams and tables."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")


def first_writes(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of a stream without those whose action_id came before, within the watermark."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["action_id"])


def append_each(rows: DataFrame, path: str, checkpoint: str):
    """Streams rows into a cache folder, batch by batch, each key once."""
    from driftloom.sources.files import append_cache

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_cache(batch.dropDuplicates(["action_id"]), path)).trigger(availableNow=True).start()
