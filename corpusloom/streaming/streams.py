"""Streams: seeds that arrive as files, progress in windows, and distinct urls with bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.sources.seeds import parse_lines


def seed_stream(spark: SparkSession, folder: str, tracking: bool = True) -> DataFrame:
    """Normalised urls of lists that arrive in a folder: (netloc, url)."""
    lines = spark.readStream.text(folder).select(F.lit(0).alias("ord"), F.col("value").alias("line"))
    u = parse_lines(lines).select(urls.normalize(F.col("url"), tracking).alias("url"))
    return u.select(urls.netloc(F.col("url")).alias("netloc"), "url").filter("netloc <> ''")


def distinct_urls(stream: DataFrame, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each url once; with a time column its state is dropped after ``delay``."""
    if ts is None:
        return stream.dropDuplicates(["url"])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def progress_windows(events: DataFrame, ts: str, failed, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """(window_start, n, n_error) in tumbling windows; the same for a table and, with ``delay`` as watermark, for a stream."""
    kind = dict(events.dtypes)[ts]
    # watermarks need a timestamp with time zone
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if delay else events
    return e.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_error")).select(F.col("window.start").cast(kind).alias("window_start"), "n", "n_error")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, giving each batch to ``sink``, and stop. ``checkpoint`` is a folder that all executors share."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
