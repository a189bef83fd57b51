"""Seed urls: from arguments, lists and retry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import urls


def parse_lines(lines: DataFrame, ord_col: str = "ord", line_col: str = "line") -> DataFrame:
    """(ord, url) of lines of a list: white space at the ends goes, blank lines and those that begin with # are left out."""
    url = F.regexp_replace(line_col, r"^\s+|\s+$", "")
    return lines.select(F.col(ord_col).cast("long").alias("ord"), url.alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def read_list(spark: SparkSession, path: str, origin: str = "file") -> DataFrame:
    """(ord, url, origin) of a file of urls, read in splits. ``ord`` follows the file, with gaps."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    return parse_lines(lines).withColumn("origin", F.lit(origin))


def collect(spark: SparkSession, url: str | None = None, file: str | None = None, retry: str | None = None) -> DataFrame:
    """(ord, url, origin): the argument, then the list, then the retry list; repeated urls stay."""
    out = spark.createDataFrame([(0, url, "arg")] if url else [], "ord long, url string, origin string")
    for path, origin in ((file, "file"), (retry, "retry")):
        if path:
            out = out.unionByName(read_list(spark, path, origin))
    return out


def by_domain(seeds: DataFrame) -> DataFrame:
    """(netloc, start_url, n_extra): the first seed of each domain and the number of others. Seeds without a domain are left out."""
    s = seeds.withColumn("netloc", urls.netloc(F.col("url"))).filter("netloc <> ''")
    return s.groupBy("netloc").agg(F.min_by("url", "ord").alias("start_url"), (F.count("*") - 1).alias("n_extra"))


def ranked(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """Of each group the first ``limit`` rows in order, with their rank from 1."""
    return df.withColumn("rnk", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rnk") <= limit)
