"""Streaming extension: events in daily windows, late ones bounded by a watermark; repeated events count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir


def daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, n, value) of a stream (or table) of events(event_id, ts, event_type, value)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Run the stream over the events there are. Windows are written whenever they change, and the last state of each counts, so those still open at the end are there too."""
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    run = uuid.uuid4().hex[:12]
    out = f"{shared_dir(spark)}/windows-{run}"

    def keep(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)  # a batch that is run again writes the same rows

    q = daily(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{shared_dir(spark)}/state-{run}").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.schema("day string, event_type string, n long, value double, batch int").parquet(out)
    last = F.max_by(F.struct("n", "value"), "batch").alias("x")
    return seen.groupBy("day", "event_type").agg(last).select("day", "event_type", "x.n", "x.value")
