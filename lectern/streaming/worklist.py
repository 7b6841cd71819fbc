"""Worklists as streams: an extension, the batch forms being the reference
point. Sitemap sightings arrive as files; every micro-batch upserts the crawl
state into a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines (url, lastmod, seen_at)."""
    return spark.readStream.schema("url string, lastmod string, seen_at timestamp").json(folder)


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (url, lastmod) once within the watermark; state is bounded."""
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["url", "lastmod"])


def per_window(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sightings per host and window; late ones count until the watermark."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)
    return stream.withWatermark("seen_at", delay).groupBy(F.window("seen_at", window).alias("w"), host.alias("host")).agg(F.count("*").alias("n")).select("w.start", "host", "n")


def keep_state(stream: DataFrame, folder: str, checkpoint: str, now: str):
    """Start a query that writes state versions folder/v=N until the input is
    used up; a batch that is replayed rewrites its own version."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ddl = "url string, lastmod string, status string, first_seen string, last_seen string"
        old = spark.read.schema(ddl).parquet(f"{folder}/v={number - 1}") if number else spark.createDataFrame([], ddl)
        state.upsert_urls(old, batch.select("url", "lastmod"), now).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
