"""Incremental scoring: a stream of crawled pages into a keyed table of page scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sitegauge.plans.page_analysis import page_scores


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events for each window and type, closed after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total")


def score_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's scores go to out/batch=<id>; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        page_scores(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
