"""Pages as a stream: all page-level operators run on it unchanged; these are the stateful ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import site_of, strip_tracking

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Files that arrive in a folder, with ``site`` and the time of arrival."""
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumns({"site": site_of(F.col("url")), "seen_at": F.current_timestamp()})


def new_urls(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first page of each URL, tracking stripped, within the watermark."""
    return stream.withColumn("url_key", strip_tracking(F.col("url"))).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["url_key"])


def new_values(items: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Items (site, key, seen_at) that their site has not shown within the watermark: cleaning of kinds without a limit."""
    return items.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["site", key])


def pages_per_site(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages of each site in windows of time."""
    return stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", window), "site").agg(F.count("*").alias("pages"))
