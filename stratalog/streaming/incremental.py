"""Incremental analysis as a stream: each micro-batch of occurrences updates the per-file decisions.

State is a table for each batch id (idempotent on replay); the next batch reads the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DecisionStream:
    """Folds micro-batches of (gallery, file, artist) rows into per-file occurrence and artist counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def fold(self, rows: DataFrame, batch: int) -> None:
        new = rows.groupBy("gallery", "file", "artist").agg(F.count("*").alias("n"))
        if batch > 0:
            new = new.unionByName(self.spark.read.parquet(self.path(batch - 1))).groupBy("gallery", "file", "artist").agg(F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(self.path(batch))

    def start(self, source: DataFrame, checkpoint: str):
        return source.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self, batch: int) -> tuple[DataFrame, DataFrame]:
        """occurrences (gallery, file, occurrence_count) and artists (gallery, artist)."""
        rows = self.spark.read.parquet(self.path(batch))
        return rows.groupBy("gallery", "file").agg(F.sum("n").alias("occurrence_count")), rows.select("gallery", "artist").distinct()


def effect_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per type and window of event time, with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
