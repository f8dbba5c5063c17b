"""Streaming intake of new page files: each URL once, counts of recent arrivals.

The audits themselves are batch jobs; the stream only keeps a de-duplicated page table current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_sightings(pages: DataFrame, url_col: str = "url", time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """Pages whose URL hasn't been seen; with a time column the state is bounded by the watermark."""
    if time_col is None:
        return pages.dropDuplicates([url_col])
    return pages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([url_col])


def arrivals(pages: DataFrame, time_col: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """host, window, pages: arrivals by host in tumbling windows."""
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1))
    return pages.withWatermark(time_col, delay).groupBy(F.window(time_col, window), host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def keep_current(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table what is available now, and ends."""
    return pages.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
