"""Pages that keep arriving: an extension; the batch engine has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import url


def new_pages(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """A stream of page files (page_id, url, html, seen timestamp): a page counts once per normalised URL within `delay`."""
    schema = "page_id long, url string, html string, seen timestamp"
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("url", url.normalize_url(F.col("url"))).where("url is not null").withWatermark("seen", delay).dropDuplicatesWithinWatermark(["url"])


def hosts_per_window(pages: DataFrame, window: str = "10 minutes") -> DataFrame:
    """(window, source_id, n): pages of each source per tumbling window."""
    return pages.groupBy(F.window("seen", window).alias("window"), url.source_id(F.col("url")).alias("source_id")).agg(F.count("*").alias("n"))
