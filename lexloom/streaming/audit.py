"""Event streams: late data, windows, sessions and exactly-once appends by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.storage import append_jdbc


def distinct_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once; state is dropped when the watermark has passed."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their values per window and type; the same expression serves batch and stream."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return src.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events with no gap as long as ``gap``."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream as Parquet; the checkpoint makes restarts exact."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream until all that is available is done. ``complete`` replaces the output with every batch, so it always is the whole
    result; ``append`` adds final rows only, each once even if a batch is tried again."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (query.foreachBatch(replace) if mode == "complete" else query.format("parquet").option("path", path)).start().awaitTermination()


def append_to_jdbc(stream: DataFrame, url: str, dbtable: str, checkpoint: str, key: str = "event_id", **options: str) -> None:
    """Events of a stream into a table of a database, each id once even if a batch is tried again."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: append_jdbc(batch, url, dbtable, key, **options)).start().awaitTermination()
