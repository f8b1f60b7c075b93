"""Extension, which the reference doesn't have: the news feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def deduplicated(articles: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops articles whose id came before within the delay. published_at may be without a time zone."""
    timed = articles.withColumn("published_at", F.col("published_at").cast("timestamp"))
    return timed.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["article_id"])


def counts(articles: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Articles by window and ticker; late ones count until the watermark passes."""
    timed = articles.withColumn("published_at", F.col("published_at").cast("timestamp")).withWatermark("published_at", delay)
    return timed.groupBy(F.window("published_at", size), "ticker").agg(F.count("*").alias("n"), F.approx_count_distinct("source").alias("sources"))
