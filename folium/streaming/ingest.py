"""Incremental ingestion: new manuscripts become paragraph rows once, counts follow event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.sources.text import blocks, segment


def paragraphs_to(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Every new row of Parquet files (doc_id, text) under ``folder`` is segmented and appended to ``out`` by batch id, so a replayed batch overwrites itself."""
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        segment(blocks(batch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and value sums by window and type; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
